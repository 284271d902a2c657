"""Each stage of the corpus pipeline against a plain version, and all of it in a row."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from causeway.llm import quality

NAMES = "the of and house river stone green light walks under seven maps quiet ocean paper glass window moves".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("row", "_row", "_gone", "_score", "_copy", "component", "times", "gone", "key", "size", "mark", "parity", "id", "n")


def sentence(r, n):
    return " ".join(r.choice(NAMES) + str(r.randrange(4000)) for _ in range(n))


def body(r, lines=6):
    return "\n".join(sentence(r, 14) for _ in range(lines))


def table(spark, rows):
    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA).repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


def got(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


ODD = [(900, None, "a"), (901, "", "b"), (902, " \t\n ", None), (903, "one", "a"), (903, "one", "a"), (None, "no name here", "b"), (904, "éàü 你好 🎉 " * 4, "a"), (905, "x" * 5000, "b")]


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, ODD).where("false")


def test_shape():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "pieces"]
    assert pipeline.ORACLE_SQL is None and all(f.__doc__ for _, f in pipeline.STAGES)


def test_empty_tables(spark, nothing, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_quality(spark, tmp_path):
    r = random.Random(5)
    rows, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, body(r, 3) + ("\n" + "\n".join("!!## " * 9 + "$$$ buy%%% now&&&" for _ in range(8)) if bad else ""), "a"))
        marks.append((i, int(not bad)))
    docs = table(spark, rows + ODD)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.learn(docs, labels)
    kept = got(pipeline.filter_quality(spark, docs, str(tmp_path)))
    assert kept == Counter(x for x in rows + ODD if model.score(x[1]) >= quality.THRESHOLD)
    assert all(kept[x] == 1 for x in rows if x[0] % 4) and not any(kept[x] for x in rows if x[0] % 4 == 0)


def test_line_dedup(spark):
    r = random.Random(6)
    passage, other = body(r, 3), body(r, 2)
    own = [body(r) for _ in range(8)]
    rows = [(0, f"{own[0]}\n{passage}", "a"), (1, f"{own[1]}\n{passage}\n{own[2]}", "b"), (2, own[0], "a"), (3, f"{other}\n{own[3]}\n{passage}", None), (4, f"{passage}\n{other}\n{own[4]}", "a"), (5, own[5], "b"), (5, own[5], "b")]
    want = [(0, f"{own[0]}\n{passage}", "a"), (1, f"{own[1]}\n{own[2]}", "b"), (3, f"{other}\n{own[3]}", None), (4, own[4], "a"), (5, own[5], "b"), (5, own[5], "b")]
    out = pipeline.dedup_lines(spark, table(spark, rows + ODD), "")
    # Document 2 has nothing of its own and goes; what is odd has no line to share.
    assert got(out) == Counter(want + ODD)
    assert all(x["n_chars"] == len(x["text"] or "") for x in out.collect())


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-12) if a | sets[j] else True:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_dedup(spark, monkeypatch):
    r = random.Random(7)
    rows = []
    for k in range(12):
        w = sentence(r, r.choice((30, 120, 400))).split()
        for _ in range(5):
            v = w[:]
            for i in r.sample(range(len(v)), max(1, int(len(v) * r.choice((0.0, 0.005, 0.02, 0.05))))):
                v[i] = f"z{r.randrange(10**6)}"
            rows.append((r.randrange(40), " ".join(v), f"s{k % 3}"))
    rows += [*rows[:3], *rows[:2], (7, "Word  here\nand there", "a"), (8, "word here and THERE", "b")] + ODD
    name = lambda d, t: hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).digest()
    groups: dict = {}
    for x, g in zip(rows, brute_groups([t for _, t, _ in rows]), strict=True):
        groups.setdefault(g, []).append(x)
    want = {min((d is None, d or 0, name(d, t)) for d, t, _ in g) for g in groups.values()}
    for run_rows in (20_000, 4):  # the second makes long runs of nearly all
        monkeypatch.setattr(pipeline.simhash, "RUN_ROWS", run_rows)
        out = pipeline.dedup_near(spark, table(spark, rows), "").collect()
        assert len(out) == len(want) and {(x["doc_id"] is None, x["doc_id"] or 0, name(x["doc_id"], x["text"])) for x in out} == want
    assert 10 < len(want) < len(rows) - 20


def test_near_dedup_goes_by_fingerprints_first(spark, monkeypatch):
    """With the search by shingles switched off, what is left is what fingerprints tell and the ratio confirms."""
    r = random.Random(8)
    words = sentence(r, 800).split()
    again = [*words[:400], "changed", *words[401:]]
    chorus = "walks under the quiet glass"
    rows = [(1, " ".join(words), "a"), (2, " ".join(again), "a"), (3, " ".join([*again[:600], "too", *again[601:]]), "b"), (4, body(r), "b")]
    rows += [(i, f"{chorus} " * 60 + sentence(r, 8), "a") for i in (5, 6)]
    prints = [pipeline.simhash.fingerprint(pipeline.simhash.shingle_hashes(t)) for _, t, _ in rows]
    apart = lambda i, j: ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count()
    assert max(apart(0, 1), apart(1, 2), apart(4, 5)) <= 4
    assert brute_groups([t for _, t, _ in rows]) == [0, 0, 0, 3, 4, 5]
    want = {1, 4, 5, 6}
    runs = []
    search = pipeline.simhash._by_run
    monkeypatch.setattr(pipeline.simhash, "_by_run", lambda rows, likeness: search(runs.append({x["id"] for x in rows.collect()}) or rows.where("false"), likeness))
    assert {x["doc_id"] for x in pipeline.dedup_near(spark, table(spark, rows), "").collect()} == want
    assert runs and all(len(x) <= 2 for x in runs)  # 5 and 6 share shingles; 1 to 3 are joined and need no search


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, body(r, 2), ("a", "b", "b", "b", "c", "c", "c", "c", None)[i % 9]) for i in range(500)] + ODD
    out = got(pipeline.mix_sources(spark, table(spark, rows), ""))
    assert out == got(pipeline.mix_sources(spark, table(spark, rows).repartition(5), ""))
    have = Counter(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(n <= 2 * have[x] and words(x[1]) for x, n in out.items())
    size, drawn = Counter(), Counter()
    for (_, t, s), n in have.items():
        size[s] += n * words(t)
    for (_, t, s), n in out.items():
        drawn[s] += n * words(t)
    # Weights 5, 2, 1, 5 in the order a, b, c, none; a and the nameless source are full at twice their size.
    left = 1.5 * sum(size.values()) - 2 * size["a"] - 2 * size[None]
    target = {"a": 2 * size["a"], None: 2 * size[None], "b": min(2 * size["b"], left * 2 / 3)}
    target["c"] = min(2 * size["c"], left - target["b"])
    assert all(abs(drawn[s] - target[s]) <= 0.12 * target[s] + 60 for s in target)


def test_pieces(spark):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.pieces.MODEL))
    r = random.Random(10)
    rows = [(i, body(r), "a") for i in range(5)] + [(6, sentence(r, 6000), "b")] + ODD
    out = pipeline.encode_pieces(spark, table(spark, rows), "").collect()
    want = Counter((d, len(e := lib.encode(t or "")), zlib.crc32(np.array(e, "<u4").tobytes()), hashlib.sha256(lib.decode(e).encode()).hexdigest()) for d, t, _ in rows)
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"], x["decoded_sha256"]) for x in out) == want
    assert max(x["n_chunks"] for x in out) > 1


def test_run_is_the_stages_in_a_row(spark, tmp_path):
    r = random.Random(12)
    rows = [(i, body(r, 4), f"s{i % 3}") for i in range(60)]
    rows += [(60 + i, rows[i][1].replace("the", "a", 1), "s0") for i in range(6)] + ODD
    table(spark, rows).select(*pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    assert sorted(map(str, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
