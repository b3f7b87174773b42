"""Sizes of pictures from generated files."""
import random
import struct

from framelark.sources import tables


def png(width, height):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", width, height) + b"\x08\x02\x00\x00\x00" + b"rest" * 9


def jpeg(width, height, rng, frame=0xC0):
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    before = b"".join(rng.choice([segment(0xE0 + rng.randrange(16), rng.randbytes(rng.randrange(400))), segment(0xDB, b"\xff\xc0" * 30), segment(0xC4, rng.randbytes(20)), b"\xff\x01", b"\xff"]) for _ in range(rng.randrange(12)))
    return b"\xff\xd8" + before + segment(frame, struct.pack(">BHH", 8, height, width) + b"\x03" + b"\x00" * 9) + segment(0xDA, b"scan") + rng.randbytes(50)


def test_sizes(spark):
    rng = random.Random(1)
    files, want = [], []
    for _ in range(60):
        size = rng.randrange(1, 65536), rng.randrange(1, 65536)
        files += [png(*size), jpeg(*size, rng, rng.choice([0xC0, 0xC1, 0xC2, 0xCF]))]
        want += [size, size]
    none = [b"", b"\xff", b"\xff\xd8", b"\xff\xd8\xff", png(5, 6)[:23], png(0, 6), jpeg(5, 6, rng)[:2], b"GIF89a" + b"\x00" * 30, b"\xff\xd8\xff\xda\x00\x04abcd", b"\xff\xd8\xff\xe0\xff\xff", b"\xff\xd8\xff\xc0\x00\x11\x08\x00", b"\xff\xd8" + b"\xff" * 50, None]
    files, want = [*files, *none], [*want, *[(None, None)] * len(none)]
    df = spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate(files)], "k int, content binary").repartition(3)
    got = {r.k: (r.width, r.height) for r in tables.with_size(df).collect()}
    assert [got[k] for k in range(len(files))] == want


def test_first_readable_of_a_folder(spark, tmp_path):
    rng = random.Random(2)
    for folder, files in {"a": {"1.png": png(9, 9)[:20], "2.jpg": jpeg(640, 480, rng), "3.png": png(7, 7)}, "b": {"1.jpeg": jpeg(8, 4, rng), "0.txt": png(1, 1)}, "c": {"1.png": b"no"}}.items():
        (tmp_path / folder).mkdir()
        for name, data in files.items():
            (tmp_path / folder / name).write_bytes(data)
    got = tables.folder_size(spark, str(tmp_path)).collect()
    assert sorted((r.folder[-1], r.width, r.height) for r in got) == [("a", 640, 480), ("b", 8, 4)]
