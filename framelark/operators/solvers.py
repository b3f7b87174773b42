"""Board pose, camera and stereo calibration: least squares on one recording's corners, a task for each recording.

A recording has a few dozen picked frames of at most one board each, so a group is small by nature.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotation(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v)
    if angle < 1e-12:
        return np.eye(3)
    k = v / angle
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross


def rodrigues(r: np.ndarray) -> np.ndarray:
    cos = np.clip((np.trace(r) - 1) / 2, -1, 1)
    angle = np.arccos(cos)
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    if angle < 1e-9:
        return axis / 2
    if np.pi - angle < 1e-6:  # a half turn: the axis is an eigenvector
        k = np.linalg.eigh((r + r.T) / 2)[1][:, -1]
        return angle * k * (1 if axis @ k >= 0 else -1)
    return axis * angle / (2 * np.sin(angle))


def projected(points: np.ndarray, r: np.ndarray, t: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
    p = points @ r.T + t
    x, y = p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]
    q = x * x + y * y
    radial = 1 + q * (d[0] + q * (d[1] + q * d[4]))
    u = x * radial + 2 * d[2] * x * y + d[3] * (q + 2 * x * x)
    v = y * radial + d[2] * (q + 2 * y * y) + 2 * d[3] * x * y
    return np.stack([k[0, 0] * u + k[0, 2], k[1, 1] * v + k[1, 2]], 1)


def turns(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3, 3) rotations of vectors (n, 3), and their derivatives (n, 3, 3, 3) by component (the second axis)."""
    angle = np.linalg.norm(v, axis=1)
    near = angle < 1e-6  # series up to the square, where the quotients lose digits
    a = np.where(near, 1.0, angle)
    sin, cos = np.sin(a), np.cos(a)
    f, g = np.where(near, 1 - angle**2 / 6, sin / a), np.where(near, 0.5 - angle**2 / 24, (1 - cos) / a**2)
    df, dg = np.where(near, -1 / 3, (a * cos - sin) / a**3), np.where(near, -1 / 12, (a * sin - 2 * (1 - cos)) / a**4)  # over the angle
    cross = np.einsum("nk,kij->nij", v, BASIS)
    square = cross @ cross
    r = np.eye(3) + f[:, None, None] * cross + g[:, None, None] * square
    step = np.einsum("kij,njl->nkil", BASIS, cross) + np.einsum("nij,kjl->nkil", cross, BASIS)
    d = f[:, None, None, None] * BASIS + g[:, None, None, None] * step
    return r, d + v[:, :, None, None] * (df[:, None, None] * cross + dg[:, None, None] * square)[:, None]


#: The cross product matrices of the axes.
BASIS = np.array([[[0.0, 0, 0], [0, 0, -1], [0, 1, 0]], [[0, 0, 1], [0, 0, 0], [-1, 0, 0]], [[0, -1, 0], [1, 0, 0], [0, 0, 0]]])


def seen_from(p: np.ndarray, k: np.ndarray, d: np.ndarray, by_camera: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Pixels (n, 2) of points (n, 3) in a camera's axes, their derivatives by point (n, 2, 3), and by fx, fy, cx, cy and
    the five of d (n, 2, 9)."""
    x, y, z = p[:, 0] / p[:, 2], p[:, 1] / p[:, 2], p[:, 2]
    q = x * x + y * y
    radial, slope = 1 + q * (d[0] + q * (d[1] + q * d[4])), d[0] + q * (2 * d[1] + 3 * q * d[4])
    u = x * radial + 2 * d[2] * x * y + d[3] * (q + 2 * x * x)
    v = y * radial + d[2] * (q + 2 * y * y) + 2 * d[3] * x * y
    ux, uy = radial + 2 * x * x * slope + 2 * d[2] * y + 6 * d[3] * x, 2 * x * y * slope + 2 * d[2] * x + 2 * d[3] * y
    vx, vy = 2 * x * y * slope + 2 * d[2] * x + 2 * d[3] * y, radial + 2 * y * y * slope + 6 * d[2] * y + 2 * d[3] * x
    fx, fy = k[0, 0], k[1, 1]
    at = np.stack([fx * ux / z, fx * uy / z, -fx * (ux * x + uy * y) / z, fy * vx / z, fy * vy / z, -fy * (vx * x + vy * y) / z], 1).reshape(-1, 2, 3)
    own = None
    if by_camera:
        o = np.zeros_like(x)
        own = np.stack([u, o, o + 1, o, fx * x * q, fx * x * q * q, fx * 2 * x * y, fx * (q + 2 * x * x), fx * x * q**3, o, v, o, o + 1, fy * y * q, fy * y * q * q, fy * (q + 2 * y * y), fy * 2 * x * y, fy * y * q**3], 1).reshape(-1, 2, 9)
    return np.stack([fx * u + k[0, 2], fy * v + k[1, 2]], 1), at, own


def by_pose(board: np.ndarray, view: np.ndarray, poses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of all views in their camera's axes (n, 3), with derivatives by their view's pose (n, 3, 6)."""
    r, d = turns(poses[:, :3])
    p = np.einsum("nij,nj->ni", r[view], board) + poses[view, 3:]
    return p, np.concatenate([np.einsum("nkij,nj->nik", d[view], board), np.broadcast_to(np.eye(3), (len(p), 3, 3))], 2)


#: Of parameters: residuals, their derivatives by the shared parameters (n, m), and by their own view's pose (n, 6).
Model = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def least_squares(model: Model, shared: np.ndarray, poses: np.ndarray, view: np.ndarray, rounds: int = 100, small: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared, poses, residuals) by Levenberg-Marquardt. A residual knows the shared parameters and the pose of its view
    (`view`, ascending) only, so poses are eliminated a view at a time: work and memory are linear in the views."""
    m, damp = len(shared), 1e-3
    first = np.searchsorted(view, np.arange(len(poses)))
    r, a, b = model(shared, poses)
    for _ in range(rounds):
        views = lambda x: np.add.reduceat(x, first, axis=0)
        aa, bb = a.T @ a, views(b[:, :, None] * b[:, None, :])
        ab, ga, gb = views(a[:, :, None] * b[:, None, :]), a.T @ r, views(b * r[:, None])
        while damp < 1e12:
            own = bb + damp * (np.einsum("nii->ni", bb) + 1e-12)[:, :, None] * np.eye(6)
            back = np.linalg.solve(own, np.concatenate([np.swapaxes(ab, 1, 2), gb[:, :, None]], 2))
            reduced = aa + damp * np.diag(np.diag(aa) + 1e-12) - np.einsum("nij,njk->ik", ab, back[:, :, :m])
            move = np.linalg.lstsq(reduced, np.einsum("nij,nj->i", ab, back[:, :, m]) - ga, rcond=None)[0] if m else np.zeros(0)
            there = shared + move, poses - back[:, :, m] - back[:, :, :m] @ move
            new, *slopes = model(*there)
            if new @ new < r @ r:
                break
            damp *= 10
        else:
            break
        gain = 1 - (new @ new) / max(r @ r, 1e-300)
        (shared, poses), r, (a, b), damp = there, new, slopes, max(damp / 10, 1e-12)
        if gain < small or r @ r < 1e-16 * len(r):
            break
    return shared, poses, r


def homography(flat: np.ndarray, seen: np.ndarray) -> np.ndarray:
    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s = p.mean(0), np.sqrt(2) / max(1e-12, np.linalg.norm(p - p.mean(0), axis=1).mean())
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return (p - c) * s, t

    a, ta = scaled(flat)
    b, tb = scaled(seen)
    (x, y), (u, v), o = a.T, b.T, np.zeros(len(a))
    rows = np.stack([x, y, o + 1, o, o, o, -u * x, -u * y, -u, o, o, o, x, y, o + 1, -v * x, -v * y, -v], 1).reshape(-1, 9)
    rows = np.concatenate([rows, np.zeros((max(0, 9 - len(rows)), 9))])  # nine at least, so that the short form has all nine directions
    h = np.linalg.inv(tb) @ np.linalg.svd(rows, full_matrices=False)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2]


def pose_from(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.linalg.inv(k) @ h
    m = m / np.sqrt(np.linalg.norm(m[:, 0]) * np.linalg.norm(m[:, 1]))
    m = -m if m[2, 2] < 0 else m
    u, _, v = np.linalg.svd(np.stack([m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1])], 1))
    return u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v, m[:, 2]


def undistorted(seen: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Pixels of the same rays without distortion."""
    n = np.stack([(seen[:, 0] - k[0, 2]) / k[0, 0], (seen[:, 1] - k[1, 2]) / k[1, 1]], 1)
    p = n.copy()
    for _ in range(20):
        x, y = p.T
        q = x * x + y * y
        radial = 1 + q * (d[0] + q * (d[1] + q * d[4]))
        p = (n - np.stack([2 * d[2] * x * y + d[3] * (q + 2 * x * x), d[2] * (q + 2 * y * y) + 2 * d[3] * x * y], 1)) / radial[:, None]
    return p * [k[0, 0], k[1, 1]] + [k[0, 2], k[1, 2]]


def board_poses(views: list[tuple[np.ndarray, np.ndarray]], k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(poses (n, 6), view of each corner, differences in pixels) of flat boards (points, pixels) of at least four corners."""
    board, seen, view = np.concatenate([b for b, _ in views]), np.concatenate([s for _, s in views]), np.repeat(np.arange(len(views)), [len(b) for b, _ in views])
    flat = np.split(undistorted(seen, k, d), np.cumsum([len(b) for b, _ in views])[:-1])
    start = [pose_from(homography(b[:, :2], s), k) for (b, _), s in zip(views, flat, strict=True)]

    def model(_: np.ndarray, poses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, turn = by_pose(board, view, poses)
        pixels, at, _ = seen_from(p, k, d)
        return (pixels - seen).ravel(), np.zeros((2 * len(p), 0)), (at @ turn).reshape(-1, 6)

    _, poses, e = least_squares(model, np.zeros(0), np.array([np.concatenate([rodrigues(r), t]) for r, t in start]), np.repeat(view, 2))
    return poses, view, e.reshape(-1, 2)


def board_pose(board: np.ndarray, seen: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(Rodrigues vector, shift, root mean square error) of a flat board of at least four corners."""
    (x,), _, e = board_poses([(board, seen)], k, d)
    return x[:3], x[3:], float(np.sqrt((e * e).sum(1).mean()))


def camera(views: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float, list[np.ndarray]]:
    """(K, d, rms, poses) from views (board points, pixels): Zhang's closed form, then all parameters together."""
    hs = [homography(b[:, :2], s) for b, s in views]

    def v(h: np.ndarray, i: int, j: int) -> np.ndarray:
        a, b = h[:, i], h[:, j]
        return np.array([a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[1] * b[1], a[2] * b[0] + a[0] * b[2], a[2] * b[1] + a[1] * b[2], a[2] * b[2]])

    size = max(float(s.max()) for _, s in views)
    norm = np.diag([1 / size, 1 / size, 1.0])
    rows = [row for h in (norm @ h for h in hs) for row in (v(h, 0, 1), v(h, 0, 0) - v(h, 1, 1))]
    b = np.linalg.svd(np.array([*rows, [0, 1e3, 0, 0, 0, 0]]))[2][-1]  # no skew
    cy = (b[1] * b[3] - b[0] * b[4]) / (b[0] * b[2] - b[1] ** 2)
    lam = b[5] - (b[3] ** 2 + cy * (b[1] * b[3] - b[0] * b[4])) / b[0]
    fx, fy = np.sqrt(abs(lam / b[0])), np.sqrt(abs(lam * b[0] / (b[0] * b[2] - b[1] ** 2)))
    k = np.diag([size, size, 1.0]) @ np.array([[fx, 0, -b[3] * fx**2 / lam], [0, fy, cy], [0, 0, 1]])
    poses = np.array([np.concatenate([rodrigues(r), t]) for r, t in (pose_from(h, k) for h in hs)])
    board, seen, view = np.concatenate([b for b, _ in views]), np.concatenate([s for _, s in views]), np.repeat(np.arange(len(views)), [len(b) for b, _ in views])

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[x[0], 0, x[2]], [0, x[1], x[3]], [0, 0, 1]]), x[4:9]

    def model(x: np.ndarray, poses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, turn = by_pose(board, view, poses)
        pixels, at, own = seen_from(p, *parts(x), by_camera=True)
        return (pixels - seen).ravel(), own.reshape(-1, 9), (at @ turn).reshape(-1, 6)

    x, poses, e = least_squares(model, np.array([k[0, 0], k[1, 1], k[0, 2], k[1, 2], 0, 0, 0, 0, 0]), poses, np.repeat(view, 2))
    return *parts(x), float(np.sqrt(2 * (e * e).mean())), list(poses)


def stereo(views: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], rounds: int = 200, small: float = 1e-7) -> dict:
    """R, T from the first to the second camera, E, F, rms of views (board, pixels in the first, in the second), with
    both cameras as given."""
    poses = board_poses([(b, s) for b, s, _ in views], *first)[0]
    others = board_poses([(b, s) for b, _, s in views], *second)[0]
    rel = []
    for p, q in zip(poses, others, strict=True):
        r = rotation(q[:3]) @ rotation(p[:3]).T
        rel.append(np.concatenate([rodrigues(r), q[3:] - r @ p[3:]]))
    board, one, two = (np.concatenate([v[k] for v in views]) for k in range(3))
    view = np.repeat(np.arange(len(views)), [len(b) for b, _, _ in views])

    def model(x: np.ndarray, poses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, turn = by_pose(board, view, poses)
        (r,), (dr,) = turns(x[None, :3])
        a, at, _ = seen_from(p, *first)
        b, there, _ = seen_from(p @ r.T + x[3:], *second)
        move = np.concatenate([np.einsum("kij,nj->nik", dr, p), np.broadcast_to(np.eye(3), (len(p), 3, 3))], 2)
        own = np.stack([np.zeros((len(p), 2, 6)), there @ move], 1)
        return np.stack([a - one, b - two], 1).ravel(), own.reshape(-1, 6), np.stack([at @ turn, there @ r @ turn], 1).reshape(-1, 6)

    x, _, e = least_squares(model, np.median(rel, 0), poses, np.repeat(view, 4), rounds, small)
    r, t = rotation(x[:3]), x[3:]
    essential = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
    f = np.linalg.inv(second[0]).T @ essential @ np.linalg.inv(first[0])
    return {"R": r, "T": t, "E": essential, "F": f / f[2, 2] if abs(f[2, 2]) > 1e-12 else f, "rms": float(np.sqrt(2 * (e * e).mean()))}


_VIEW = ["bx", "by", "bz"]


def views_of(df: pd.DataFrame, frame: str, *seen: tuple[str, str]) -> list[tuple[np.ndarray, ...]]:
    return [tuple(g[list(c)].to_numpy(float) for c in (_VIEW, *seen)) for _, g in df.sort_values([frame, "corner_id"]).groupby(frame)]


def solve_poses(corners: DataFrame, keys: list[str], k: np.ndarray, d: np.ndarray, least: int = 4) -> DataFrame:
    """(keys, rvec, tvec, rms) of frames (keys, corner_id, x, y, bx, by, bz) with at least `least` corners."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        if len(df) < least:
            return pd.DataFrame(columns=[*keys, "rvec", "tvec", "rms"])
        r, t, rms = board_pose(df[_VIEW].to_numpy(float), df[["x", "y"]].to_numpy(float), k, d)
        return pd.DataFrame([{**{c: df[c].iloc[0] for c in keys}, "rvec": r, "tvec": t, "rms": rms}])

    return corners.groupBy(*keys).applyInPandas(one, _schema(corners, keys) + "rvec array<double>, tvec array<double>, rms double")


def calibrate(corners: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """(keys, camera_matrix, distortion_coeffs, rms, n_views) of (keys, frame, corner_id, x, y, bx, by, bz)."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        views = views_of(df, frame, ("x", "y"))
        k, d, rms, _ = camera(views)
        return pd.DataFrame([{**{c: df[c].iloc[0] for c in keys}, "camera_matrix": k.tolist(), "distortion_coeffs": [d.tolist()], "rms": rms, "n_views": len(views)}])

    return corners.groupBy(*keys).applyInPandas(one, _schema(corners, keys) + "camera_matrix array<array<double>>, distortion_coeffs array<array<double>>, rms double, n_views long")


def with_camera(rows: DataFrame, keys: list[str], cameras: DataFrame, name: str) -> DataFrame:
    """rows with their recording's camera of calibrate() as columns <name>_k and <name>_d."""
    return rows.join(cameras.select(*keys, F.col("camera_matrix").alias(f"{name}_k"), F.col("distortion_coeffs").alias(f"{name}_d")), keys)


def camera_in(df: pd.DataFrame, which: tuple[np.ndarray, np.ndarray] | str) -> tuple[np.ndarray, np.ndarray]:
    """(K, d): as given, or those of a recording's rows by the name that with_camera gave them."""
    if not isinstance(which, str):
        return which
    return np.stack(df[f"{which}_k"].iloc[0]).astype(float), np.stack(df[f"{which}_d"].iloc[0]).astype(float).ravel()


def stereo_calibrate(pairs: DataFrame, keys: list[str], first: tuple | str, second: tuple | str, frame: str = "frame") -> DataFrame:
    """One row a recording of (keys, frame, corner_id, xa, ya, xb, yb, bx, by, bz): rotation and shift in their units, E, F,
    rms. The cameras are given for all recordings, or by the names of each one's own."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        s = stereo(views_of(df, frame, ("xa", "ya"), ("xb", "yb")), camera_in(df, first), camera_in(df, second))
        v = rodrigues(s["R"])
        row = {"rotation_matrix_3x3": s["R"].tolist(), "rotation_rodrigues": v, "rotation_degrees": np.degrees(v), "translation_metres": s["T"], "translation_cm": s["T"] * 100, "essential_matrix": s["E"].tolist(), "fundamental_matrix": s["F"].tolist(), "stereo_rms_px": s["rms"]}
        return pd.DataFrame([{**{c: df[c].iloc[0] for c in keys}, **row}])

    m, a = "array<array<double>>", "array<double>"
    return pairs.groupBy(*keys).applyInPandas(one, _schema(pairs, keys) + f"rotation_matrix_3x3 {m}, rotation_rodrigues {a}, rotation_degrees {a}, translation_metres {a}, translation_cm {a}, essential_matrix {m}, fundamental_matrix {m}, stereo_rms_px double")


def _schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keys)
