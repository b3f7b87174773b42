"""Deduplication, language, scores, secrets, packing and pieces against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelark.llm import graph, jaccard, language, lm, packing, pieces, secrets, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SF = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def cut_repeats(texts: dict[int, str | None], window: int = 13) -> dict[int, tuple[int, int, str]]:
    first, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g))
    return out


def linked(texts: dict[int, str | None], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts_of(messy):
    return {r[0]: r[1] for r in messy}


@pytest.mark.parametrize("size", [1 << 18, 50])
def test_substrings(spark, messy, documents, folder, size, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", size)
    want = cut_repeats(texts_of(messy))
    got = substrings.op1_substring_dedup(spark, folder).collect()
    assert len(got) == len(messy)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == (*want[r.doc_id][:2], sha(want[r.doc_id][2])) for r in got)
    spans = {r.doc_id: r.repeats for r in substrings.kept_texts(documents).collect()}
    assert all(sum(n for _, n in spans[i]) == want[i][1] for i in want)
    assert any(n > 50 for s in spans.values() for _, n in s)


def test_suffix_tree_nodes():
    rows = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [9, 9, 9]], np.uint32)
    order, node = substrings.deep_nodes(rows, 3)
    assert {tuple(rows[i]) for i in order[node == node[list(order).index(0)]]} == {(1, 2, 3)}
    order, node = substrings.deep_nodes(rows, 2)
    assert len(set(node[[list(order).index(k) for k in (0, 1, 2)]])) == 1


def test_plan_splits_large_prefixes_only():
    counts = np.array([[5, 500, 0], [3, 400, 100], [3, 400, 100]])
    plan = substrings.make_plan(counts, 100)
    assert plan[0, 0] >= 0 and plan[0, 1] == -1 and plan[1, 1] == -1 and plan[1, 2] >= 0 and plan[2, 1] >= 0


def test_jaccard(spark, messy, folder):
    want = linked(texts_of(messy))
    got = jaccard.op3_ngram_jaccard(spark, folder).collect()
    assert len(got) == len(messy) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert max(Counter(c for _, c in want.values()).values()) >= 10


def test_jaccard_exact_bound_and_random_sets(spark, monkeypatch):
    rng, texts = random.Random(5), {}
    base = [f"w{k}" for k in range(60)]
    for i in range(150):
        w = list(base[: rng.randrange(20, 60)])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(6)}"
        texts[i] = " ".join(w)
    # 7 of 28 shingles differ on one side: 21 * 100 = 75 * 28
    a = [f"q{k}" for k in range(32)]
    texts[1000], texts[1001] = " ".join(a), " ".join(a[:25])
    want = linked(texts)
    assert want[1001][1] == 1000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for growth, spread, fragments in ((3, 5, 7),):
        monkeypatch.setattr(jaccard, "GROWTH", growth)
        monkeypatch.setattr(jaccard, "SPREAD", spread)
        monkeypatch.setattr(jaccard, "FRAGMENTS", fragments)
        got = jaccard.join(docs).collect()
        assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUBS", 5)
    links = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(20)] + [(200, 39), (300, 301)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == dict.fromkeys([*range(40), 200], 0) | dict.fromkeys(range(100, 121), 100) | {300: 300, 301: 300}


def test_large_groups_make_few_pairs(spark):
    """Near copies of one text, not all linked with each other: pairs grow with the copies, not with their square."""
    rng, base, texts = random.Random(8), [f"w{k}" for k in range(200)], {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    found = jaccard.sets(jaccard.blocks(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    at = found.where("prefix IS NOT NULL").select("doc_id", "n", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("doc_id", "n", F.col("p.prefix").alias("shingle"), F.col("p.places").alias("place"))
    assert jaccard.met(jaccard.turn_of(at.withColumn("comp", F.col("doc_id")), 0)).count() < 3 * len(texts)
    want = linked(texts)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())


def test_unequal_texts_under_one_id(spark):
    a, b = [" ".join(f"{c}{k}" for k in range(40)) for c in "ab"]
    rows = [(1, a), (5, b), (5, a + " more"), (9, b + " again"), (None, a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 36, 1), (5, 36, 1), (5, 37, 1), (9, 37, 1)]


def test_language(spark, messy, folder):
    p = language.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = p[p.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and p.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(p.doc_id, p.held_out, strict=True))
    got = {r.doc_id: r.lang_pred for r in language.op4_language(spark, folder).collect()}
    assert {i for i, v in got.items() if v == "und"} == {0, 1, 2, 11}


def test_phrases_against_plain_search():
    data, text = b"the cat sat on the mat and the rat", b"the rat sat on a zebra" * 40
    parser = language.Parser.of({"x": data})
    n = 0
    for at in range(0, len(text), language.STRETCH):
        part = text[at : at + language.STRETCH]
        k = 0
        while k < len(part):
            m = 1
            while k + m < len(part) and part[k : k + m + 1] in data:
                m += 1
            n, k = n + 1, k + m
    assert parser.phrases([text, b""]).tolist() == [[n], [0]]


def test_language_without_labels(spark):
    d = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in language.identify(d, language.labelled_sample(d)).collect()] == [("und", 0.0)]


def test_scores(spark, messy, folder):
    got = lm.op5_log_bilinear(spark, folder).collect()
    tokens = {r[0]: [*WORD.findall((r[1] or "").translate(LOWER)), None] for r in messy}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(t for r in messy if not held[r[0]] for t in tokens[r[0]])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(messy)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
        assert r.score < 0


def test_scores_do_not_depend_on_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 5000)
    monkeypatch.setattr(lm, "WIDTH", 2)
    score = lambda n: sorted((r.doc_id, r.score) for r in lm.score_documents(documents.repartition(n)).collect())
    a, b = score(1), score(7)
    assert [i for i, _ in a] == [i for i, _ in b] and [x for _, x in a] == pytest.approx([x for _, x in b], rel=1e-6)  # single precision


def test_model_is_normalised_and_beats_the_base(spark):
    for n in (1, 10, 60):  # every symbol, those in classes with others included
        m = lm.Model.start(np.arange(float(n))[::-1])
        c = np.array([[n // 3, n], [0, n // 2]])
        p = np.stack([np.exp(m.log_probability(c, np.full(2, k))) for k in range(n)])
        assert np.allclose(p.sum(0), 1)
    p = lm.op5_log_bilinear(spark, SF).toPandas()
    q = p[p.held_out]
    assert q.score.sum() > q.base_score.sum()


def test_training_learns_members_of_classes():
    rng, n = np.random.default_rng(1), 100
    before = rng.integers(0, n, 60_000)
    wanted = (before + 1) % n  # the next symbol follows from the one before
    c = np.stack([before, np.full(len(before), n)], 1)
    m = lm.Model.start(np.ones(n))
    memory = [np.full(a.shape, 1e-6, np.float32) for a in m.arrays()]
    start = m.log_probability(c, wanted).mean()
    for k in range(4):
        lm.train(m, c, wanted, np.full(n, 1 / n), memory, np.random.default_rng(k))
    assert start < -4 and m.log_probability(c, wanted).mean() > -2
    members = wanted >= lm.Classes.of(n).single
    assert m.log_probability(c[members], wanted[members]).mean() > -2.5


def test_symbols_grow_with_the_table(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * 7919 + k * 104729) % (k + 1)}" for k in range(200))) for i in range(60)]

    def own(rows):
        return len(lm.count(lm.blocks(spark.createDataFrame(rows, "doc_id long, text string")))[1].frequent)

    monkeypatch.setattr(lm, "OWN", 8)
    few, many = own(texts[:10]), own(texts)
    assert 0 < few < many <= 8 * (61 * 201) ** (1 / 3)


BASE = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]+"), 0, 32)}
SECRETS = [None, "", "token=token:abcdefgh1", "PassWord : 'abcdefgh' x", "api_key=short apikey=\"longenough/+=.\"", "AKIA" + "Z" * 11, "AKIA" + "Z" * 12 + " é AKIA", "é" * 5 + "0123456789abcdef" * 3 + "g", "f" * 31, "secret=" + "deadbeef" * 8, "ghp_" + "a" * 36, "secret==abcdefgh secret=abc secret=abcdefghi", "x" * 50000 + " token=abcdefghij"]


def base_spans(t):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(t or "") if len(m[g]) >= n]
    return [f"{kind}:{a}:{b}" for a, k, b, kind in sorted(found)]


def test_secrets(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*SECRETS, SECRETS[3], SECRETS[3]])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in secrets.op8_secret_scan(spark, str(tmp_path)).collect():
        want = base_spans(dict(rows)[r.doc_id])
        assert r.base_sha256 == sha(",".join(want))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == want
    assert "forge:0:40,hex:4:40" in {r.spans for r in secrets.op8_secret_scan(spark, str(tmp_path)).collect()}


def test_ledger_scans_only_what_is_new(spark):
    v1 = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "nothing"), ("c", "token=abcdefgh1")], "path string, text string")
    first = secrets.scan_unseen(v1).cache()
    assert first.count() == 2 and secrets.scan_unseen(v1, first).count() == 0
    v2 = v1.union(spark.createDataFrame([("a", "token=zzzzzzzz9")], "path string, text string"))
    assert secrets.scan_unseen(v2, first).count() == 1
    newer = (secrets.Rule("assign", secrets.RULES[0].pattern, 2, 8, version=2), *secrets.RULES[1:])
    again = secrets.scan_unseen(v1, first, newer).collect()
    assert {tuple(r.tags) for r in again} == {("assign@2",)}
    paths = [(r.path, len(r.spans)) for r in secrets.findings_by_path(v2, first.union(secrets.scan_unseen(v2, first))).collect()]
    assert sorted(paths) == [("a", 1), ("a", 1), ("b", 0), ("c", 1)]
    assert sorted(r.text for r in secrets.redact(secrets.findings_by_path(v1, first)).collect()) == ["[assign]", "[assign]", "nothing"]


def test_versions_of_a_rule_and_repeated_appends(spark, tmp_path):
    """Only the spans of the version asked for come out; what a ledger holds twice counts once."""
    v = spark.createDataFrame([("a", "token=abcdefgh1 x"), ("b", "token=abcdefgh1 x"), ("c", None)], "path string, text string")
    old, path = secrets.RULES, f"{tmp_path}/ledger"
    new = (*secrets.RULES[1:], secrets.Rule("assign", r"token=[a-z0-9]+\x20x", 0, 1, version=2))  # also in another place among the rules
    once = secrets.update_ledger(v, path, old).collect()
    assert {len(r.found) for r in once} == {len(old)}
    ledger = secrets.update_ledger(v, path, new)
    assert ledger.count() == 4 and secrets.update_ledger(v, path, new).count() == 4
    spans = lambda rules: [secrets.findings_by_path(v, spark.read.parquet(path), rules=rules).where("path = 'a'").select(secrets.joined(F.col("spans"))).first()[0] for _ in range(1)]
    assert spans(old) == ["assign:0:15"]
    assert spans(new) == ["assign:0:17"]
    spark.read.parquet(path).coalesce(1).write.parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("append").parquet(path)  # as after a retried append
    assert ledger.count() < spark.read.parquet(path).count() == 8
    assert spans(old) == ["assign:0:15"] and spans(new) == ["assign:0:17"]


def test_many_findings_in_one_text(spark):
    """As many findings as fit into some megabytes: places and redacted text against plain Python."""
    some = [f"é token=abcdefgh{k:05d} {k:032x}" for k in range(50_000)]
    text = "\n".join(some)
    rows = spark.createDataFrame([(1, text), (2, text + "x"), (3, "token=" + "f" * 2000 + " " + "0" * 3000)], "doc_id long, text string")
    found = secrets.findings_by_path(rows, secrets.scan_unseen(rows))
    got = {r.doc_id: r for r in secrets.redact(found.withColumn("joined", secrets.joined(F.col("spans")))).collect()}
    assert len(got[1].spans) == 100_000 and sha(got[1].joined) == sha(",".join(base_spans(text)))
    want = "\n".join(["é [assign] [hex]"] * 50_000)
    assert [sha(got[k].text) for k in (1, 2)] == [sha(want), sha(want + "x")]
    assert got[3].text == "[assign] [hex]"


def test_stored_ledger(spark, tmp_path):
    v1 = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "nothing"), (None, None)], "path string, text string")
    v2 = v1.union(spark.createDataFrame([("a", "token=zzzzzzzz9")], "path string, text string"))
    path = f"{tmp_path}/ledger"
    assert [secrets.update_ledger(v, path).count() for v in (v1, v1, v2, v2)] == [3, 3, 4, 4]
    assert sorted((r.path or "", len(r.spans)) for r in secrets.findings_by_path(v2, spark.read.parquet(path)).collect()) == [("", 0), ("a", 1), ("a", 1), ("b", 0)]


def test_secret_query_is_native(spark, folder):
    plan = secrets.op8_secret_scan(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_packing(spark, messy, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts_of(messy).items()}
    got = packing.op2_packing(spark, folder).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length, r.tier))
        by_doc[r.doc_id].append((r.start, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    copies = Counter(r[0] for r in messy)
    for i, spans in by_doc.items():
        assert sorted(k for s, n in spans for k in range(s, s + n)) == sorted(list(range(len(ids[i]))) * copies[i])
    for pieces_ in by_seq.values():
        at = 0
        for offset, n, _ in sorted(pieces_):
            assert offset == at
            at += n
        assert at == pieces_[0][2] and at & (at - 1) == 0 and at <= 2048
    assert set(by_doc) == set(ids)


@pytest.mark.parametrize("text", ["a\xa0  b", "a\xa0\n\n", "x \x85y", "  z  ", "\n\n a", "it's 'll", "a\x1c\x1d b", "<|endoftext|> a", "", "é́ 中文  字", "1 2  3\t\t4", "a b   c", "x" + " " * 999 + "y", "x" + " " * 1_000_000, "\n" * 1_000_000, " \n\t\r" * 250_000 + "<|endoftext|>a", "ab" * 300_000], ids=range(17))
def test_ids_equal_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.shared_ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")).of(text)
    assert np.frombuffer(own, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n\n b", "<|endoftext| > c", "plain", ""])
def test_ids_equal_the_unmodified_tokenizer(spark, tmp_path, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END], "<u4")
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (packing.op2_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        rows = got.collect()
        assert sum(r.length for r in rows) == len(want) and {r.doc_tokens for r in rows} == {len(want)}
        assert all(r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in rows)


def test_pieces(spark, messy, folder):
    import public_tokenizers

    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["", " ", "a ", "  a\n\tb ﬁ ½  c ", "▁x ▁▁y", "\x00\x01 a", "<s> </s> <0x0A>", "🙂🙃" * 5, "aaaa" * 60, "the" * 100, "x\r\ny"]
    for t in odd:
        want = p.library.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(p.encode([t])[0], "<u4").tolist() == want
        if t:
            assert p.agenda(pieces.MARK + t.replace(" ", pieces.MARK)) == want[1:-1]
    for r in pieces.op6_sentencepiece(spark, folder).collect():
        ids = p.library.encode(texts_of(messy)[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(p.library.decode(ids)))


@pytest.mark.parametrize("query", [substrings.op1_substring_dedup, packing.op2_packing, jaccard.op3_ngram_jaccard, language.op4_language, lm.op5_log_bilinear, pieces.op6_sentencepiece, secrets.op8_secret_scan])
def test_empty_tables(spark, bare, query):
    assert query(spark, bare).count() == 0


@pytest.mark.parametrize("query", [substrings.op1_substring_dedup, packing.op2_packing, jaccard.op3_ngram_jaccard, lm.op5_log_bilinear, secrets.op8_secret_scan])
def test_extra_columns_with_clashing_names(spark, tmp_path, query):
    d = spark.createDataFrame([(k, "a b c d e f g token=abcdefghi " * 3) for k in range(3)], "doc_id long, text string")
    for c in ("rep", "component", "blob", "spans", "block", "score", "n_words", "kept", "sequence_id", "lang", "prefix"):
        d = d.withColumn(c, F.lit("x"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in query(spark, str(tmp_path)).collect()} == {0, 1, 2}


def test_components_of_few_links_leave_few_files(spark):
    """Shuffle files go by tasks: few links have few, whatever the number of shuffle partitions; hubs and chains are right."""
    from framelark.llm import graph

    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 1400)] + [(5000, 4000), (4000, 4500)]
        got = graph.components(spark.createDataFrame(links, "x long, y long"))
        assert got.rdd.getNumPartitions() <= 8
        assert {r.id: r.component for r in got.collect()} == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 1400)}, 4000: 4000, 4500: 4000, 5000: 4000}
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
