"""Each operator against a brute-force version, and on rows that are easy to get wrong."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import lines, mixing, pieces, quality, queries, simhash, spotsigs, suffixes, tiff, toxicity, wavelet

NAMES = "the of and house river stone green light walks under seven maps quiet ocean paper glass window moves".split()
CLASHES = ("row", "size", "key", "slice", "score", "fp", "n", "shard", "taken", "target", "label", "media", "spans", "gone", "begin", "finish", "mark", "ids", "chunk", "copies", "borrowed")


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(NAMES) + str(r.randrange(400)) * r.randrange(2) for _ in range(n))


def corpus() -> list[tuple]:
    r = random.Random(11)
    passage = sentence(r, 90)
    rows = []
    for i in range(60):
        text = "\n".join(sentence(r, r.randrange(4, 25)) for _ in range(r.randrange(1, 7)))
        if i % 7 == 0:
            text += "\n" + passage + "\n" + sentence(r, 9)
        rows.append((i, text, f"s{i % 4}"))
    rows += [(60 + k, rows[3][1], "s0") for k in range(4)]  # exact copies
    rows += [(64 + k, rows[5][1].replace("river", "creek", 1), "s1") for k in range(3)]  # near copies
    rows += [(70, None, "s0"), (71, "", None), (72, " \t\n ", "s2"), (73, "word", None), (73, "word", None), (74, "éàü 你好 🎉", "s3"), (None, "a row without an id", "s1"), (75, "x" * 3000, "s2"), (76, "ab " * 2500, "s0"), (77, sentence(r, 9000), "s1")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=lambda x: (x[0] is None, *map(str, x)))


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))


def test_simhash(docs, rows, nothing):
    marks = []
    for doc, text, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        import xxhash

        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        marks.append((doc, sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))))
    want = []
    for doc, fp in marks:
        reach, todo = {fp}, [fp]
        while todo:
            x = todo.pop()
            for _, y in marks:
                if y not in reach and (x ^ y).bit_count() <= 2:
                    reach.add(y)
                    todo.append(y)
        names = [d for d, y in marks if y in reach and d is not None]
        want.append((doc, f"{fp:016x}", min(names) if names else None))
    got = by_id(simhash.query(docs), "fingerprint", "component_id")
    assert got == sorted(want, key=lambda x: (x[0] is None, *map(str, x)))
    assert simhash.query(nothing).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_near_links_find_every_pair(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for _ in range(15):
            x = b
            for bit in r.sample(range(64), r.randrange(1, radius + 2)):
                x ^= 1 << bit
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius).collect()
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
        parent[find(a)] = find(b)
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                assert find(a) == find(b)


def test_long_runs_are_joined_by_masks(monkeypatch):
    r = np.random.default_rng(2)
    fps = np.unique(np.bitwise_xor(np.uint64(2**40 + 7), (np.uint64(1) << r.integers(0, 12, 300).astype(np.uint64)) | (np.uint64(1) << r.integers(0, 12, 300).astype(np.uint64))))
    plain = simhash._joined(fps, 2, 0)
    monkeypatch.setattr(simhash, "LONG_RUN", 1)
    assert len(simhash._joined(fps, 2, 0)) >= len(plain)


def test_components_in_rounds_and_at_once(spark):
    from causeway.llm.components import components

    r = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(30)] + [(r.randrange(200, 230), r.randrange(200, 230)) for _ in range(20)]
    df = spark.createDataFrame(links, "a long, b long")
    once = {tuple(x) for x in components(df).collect()}
    assert once == {tuple(x) for x in components(df, one_task=0).collect()}
    assert {b for a, b in once if a < 60} == {0}
    assert components(df.where("false")).count() == 0


def grouped(df, **options):
    """Each row's group, named by its least row."""
    got = [(x["row"], x["component"]) for x in simhash.alike(df, **options).collect()]
    least = {c: min(r for r, other in got if other == c) for _, c in got}
    return {r: least[c] for r, c in got}


def test_likeness_finds_edited_copies(spark):
    r = random.Random(8)
    texts = [sentence(r, 300) for _ in range(40)]
    near = []
    for t in texts[:15]:
        w = t.split()
        for i in r.sample(range(len(w)), 2):
            w[i] = "changed"
        near.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate([*texts, *near])), "row long, text string")
    got = grouped(df)
    assert all(got[40 + i] == got[i] for i in range(15))
    assert len({got[i] for i in range(40)}) == 40


def set_likeness(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def test_a_bridge_that_shares_a_run_does_not_hide_a_pair(spark):
    # Document 0 is short of both others' likeness, comes first in the runs of what it shares, and 1 and 2 are alike.
    r = random.Random(4)
    w = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(w[:140]), " ".join(w), " ".join([*w[:190], *(f"x{i}" for i in range(10))])]
    assert set_likeness(texts[0], texts[1]) < 0.8 <= set_likeness(texts[1], texts[2]) and set_likeness(texts[0], texts[2]) < 0.8
    got = grouped(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert got == {0: 0, 1: 1, 2: 1}


def test_likeness_is_exact(spark):
    r, texts = random.Random(12), []
    for _ in range(60):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.choice((12, 60, 300)))]
        texts.append(" ".join(w))
        for _ in range(3):  # copies of likeness 0.75 to 0.95: the end is rewritten, or words here and there
            v, share = w[:], r.uniform(0.75, 0.95)
            if r.random() < 0.5:
                v[int(len(w) * 2 * share / (1 + share)) :] = [f"y{r.randrange(10**6)}" for _ in w[int(len(w) * 2 * share / (1 + share)) :]]
            else:
                for i in r.sample(range(len(w)), max(1, round(len(w) * (1 - share) / (1 + share) / 5))):
                    v[i] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(v))
    root = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i // 4 * 4, i) if set_likeness(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    got = grouped(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert got == dict(enumerate(root)) and 60 < len(set(root)) < 200


def test_likeness_in_runs_that_take_several_rounds(spark):
    # All share a passage that is most of each text, in many groups that are not alike.
    r = random.Random(6)
    passage, texts = [f"p{i}" for i in range(60)], []
    for _ in range(30):
        own = [f"w{r.randrange(10**6)}" for _ in range(20)]
        texts += [" ".join([*passage, *own]), " ".join([*passage, *own[:-1], f"v{len(texts)}"])]
    got = grouped(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert got == {i: i // 2 * 2 for i in range(60)}
    # Runs of more members than a task may hold go to blocks and pairs of blocks.
    assert got == grouped(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), run_rows=7)


def test_parities_bound_the_difference():
    r = np.random.default_rng(3)
    for n in (3, 200, 300, 700, 1500):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(n * 0.9)], r.integers(0, 2**63, n // 8 + 1).astype(np.uint64))))
        sizes, marks = np.sort([len(a), len(b)]), [simhash.parities(x) for x in sorted((a, b), key=len)]
        found = simhash.run_pairs(sizes, np.array([0, 1]), marks, 0, 0.01)[0]
        assert found == [(0, 1)]
        alike = simhash.jaccard(a, b)
        assert simhash.run_pairs(sizes, np.array([0, 1]), marks, 0, alike)[0] == [(0, 1)]
        assert simhash.run_pairs(np.repeat(sizes, 20), np.arange(40), [x for x in marks for _ in range(20)], 0, alike)[0].count((0, 20)) == 1


def labelled(spark, column):
    r = random.Random(5)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = "\n".join(sentence(r, 14) for _ in range(4))
        if column == "quality" and bad:
            text += "\n" + "\n".join("!!## " * 9 + "$$$ buy%%% now&&&" for _ in range(8))
        if column == "toxic" and bad:
            text += "\nyou vilebrute and filthscum"
        rows.append((i, text, 1 - bad if column == "quality" else int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], f"doc_id long, {column} int")


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, docs, nothing, rows, module, column):
    own, labels = labelled(spark, column)
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    got = module.query(own, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    flipped = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(column)).otherwise(F.col(column)))
    again = {r["doc_id"]: r["score"] for r in module.query(own, flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)  # held-out labels are not read
    odd = module.query(docs, labels)
    assert odd.count() == len(rows) and odd.where("score between 0 and 1").count() == len(rows)
    assert module.query(nothing, labels).count() == 0
    assert {r["score"] for r in module.query(own, labels.where("false")).collect()} == {0.5}


def test_crf_marginals_are_those_of_all_labelings():
    import itertools

    r = np.random.default_rng(3)
    s, t = r.normal(size=5), r.normal(size=(2, 2))
    weight = {y: np.exp(sum(s[i] * y[i] for i in range(5)) + sum(t[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=5)}
    want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(5)]
    assert np.allclose(quality.marginals(s, t), want)


def test_swaps_make_identity_terms_neutral():
    names = sorted({"=" + w for w in toxicity.IDENTITY} | {"=vilebrute"})
    at = {n: i for i, n in enumerate(names)}
    # In the sample, one group is mentioned mostly in toxic documents.
    rows = [(1, [at["=women"], at["=vilebrute"]])] * 30 + [(1, [at["=women"]])] * 10 + [(0, [at["=men"]])] * 30 + [(0, [])] * 30
    moved = Counter(m for _ in range(70) for m in toxicity.swaps("these women and those men.", at))
    plain, fair = toxicity.fit(names, rows, {}), toxicity.fit(names, rows, moved, penalty=400.0)
    assert (plain.swapped, fair.swapped) == (0, 700)
    gap = lambda m: m.score("women walk") - m.score("men walk")
    assert gap(plain) > 0.3 and abs(gap(fair)) < 0.1 and fair.score("vilebrute") > fair.score("walk")


def test_words_that_stand_for_each_other_become_swap_terms(spark):
    r = random.Random(14)
    towns, rows, labels = ["arden", "belmont", "corwen", "dunmore"], [], []
    for i in range(600):
        toxic = i % 3 == 0
        # One town is named mostly where the text is toxic; all stand in the same places.
        town = "arden" if r.random() < (0.45 if toxic else 0.3) else r.choice(towns[1:])
        lines_ = [f"people from {town} came over the hill" for _ in range(2)] + [sentence(r, 12)]
        rows.append((i, ". ".join(lines_) + (". you vilebrute" if toxic else ""), "s"))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, plain = toxicity.learn(docs, marks, penalty=400.0), toxicity.learn(docs, marks, penalty=0.0)
    assert fair.terms["arden"] == tuple(towns) and fair.swapped > 1000
    gap = lambda m: max(m.score(f"people from {t} came") for t in towns) - min(m.score(f"people from {t} came") for t in towns)
    assert gap(fair) < 0.5 * gap(plain)
    assert fair.score("you vilebrute") > 0.5 > fair.score("people from arden came over the hill")


def test_wavelet(docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(wavelet.TOKENIZER))
    at, want = 0, []
    for doc, text, _ in ordered(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = by_id(wavelet.query(docs), "start", "n_tokens", "ids_crc32")
    assert got == sorted(want, key=lambda x: (x[0] is None, *map(str, x)))
    assert wavelet.query(nothing).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 9), (1, 1), (63, 5), (64, 900), (1000, 3), (3000, 70000), (32768, 2), (150_000, 900)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids, np.array([0, n])).to_bytes())
    assert m.decode().tolist() == ids.tolist() and m.access(np.arange(n)).tolist() == ids.tolist()
    for x in [*ids[:5].tolist(), top + 1]:
        places = np.flatnonzero(ids == x).tolist()
        assert m.occurrences(x) == places and m.rank(x, n // 2) == sum(p < n // 2 for p in places) and m.select(x, len(places)) == -1


def test_a_look_up_inflates_a_block_a_plane():
    ids = np.random.default_rng(7).integers(0, 5000, 300_000)
    data = wavelet.WaveletMatrix.of(ids, np.array([0, len(ids)])).to_bytes()
    m = wavelet.WaveletMatrix.from_bytes(data)
    assert m.inflated() == 0
    assert m.access([123_456]).tolist() == [ids[123_456]]
    assert m.inflated() == m.bits == 13
    token = int(ids[200_000])
    assert m.rank(token, 200_000) == (ids[:200_000] == token).sum()
    assert m.inflated() <= 3 * m.bits < 13 * wavelet.WaveletMatrix.blocks(len(ids))
    # The directory is a small share of the planes.
    assert 13 * (1 + 2 * wavelet.WaveletMatrix.blocks(len(ids))) * 4 < 0.01 * len(data)


def test_tokenizer_words_are_cut_where_the_tokenizer_cuts():
    import public_tokenizers

    e = wavelet.Encoder(public_tokenizers.path(wavelet.TOKENIZER))
    texts = ["don't we'll O'Neil's", "a1b2,c3. (x) y_z", "É́a é ÀB,", "<|endoftext|> <|startoftext|>x", "a b\x1cc\x85d", "Σας ΣΑΣ", "it's,'s", "　x", "-- 5%% ..a", "a.'s b-'t c'.d", "<|ENDOFTEXT|> A.b", "İİ K.k É.é x\u0301.y", "(a)b_c=d", "..."]
    for text, ids in zip(texts, e.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_tiff_query(docs, rows, nothing):
    got = {(r["doc_id"], r["n_bytes"]): r for r in tiff.query(docs).collect()}
    for doc, text, _ in rows:
        data = (text or "").encode()
        p = data.ljust(max(1, -(-len(data) // 192)) * 192)
        r = got[doc, len(data)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        n, media = tiff.store(text)
        assert (r["n_bytes"], r["media_bytes"], r["media_sha256"]) == (n, len(media), hashlib.sha256(media).hexdigest())
        count, mean, spread, shares = r["feature"].split(":")
        assert int(count) == -(-len(p) // 192 // tiff.PAGE_ROWS) and abs(float(mean) - sum(p) / len(p)) < 1e-4 and abs(float(spread) - np.std(list(p))) < 1e-4
        assert [int(shares[i : i + 3], 16) for i in range(0, 48, 3)] == [1000 * sum(x // 16 == k for x in p) // len(p) for k in range(16)]
    assert tiff.query(nothing).count() == 0


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    r = np.random.default_rng(1)
    for shape, kind in (((5, 7), np.uint8), ((70, 40, 3), np.uint8), ((33, 9), np.uint16), ((300, 300), np.uint8)):
        image = r.integers(0, 250, shape).astype(kind)
        for tile in (None, (16, 32)):
            for order in "<>":
                first, second = tiff.pages(tiff.write_tiff([image, image[:2]], compression, predictor, 16, tile, order))
                assert first[4] == image.astype(image.dtype.newbyteorder("<")).tobytes() and second[1] == 2


def test_tiff_faults(spark):
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8)])
    rows = [(0, None), (1, b""), (2, b"not a picture"), (3, good[:20]), (4, good), (5, good)]
    got = tiff.decode_pages(spark.createDataFrame(rows, "k long, media binary")).collect()
    assert [(r["k"], r["error"] is None) for r in got] == [(0, False), (1, False), (2, False), (3, False), (4, True), (5, True)]


def test_spotsigs(docs, rows, nothing):
    inside = ordered(rows)
    got = by_id(spotsigs.query(docs), "n_chars", "edited_sha256", "near_edited", "near_next")
    want = []
    for i, (doc, text, _) in enumerate(inside):
        text, after = text or "", inside[(i + 1) % len(inside)][1] or ""
        k = len(text) // 4
        changed = text[: len(text) - k] + after[:k]
        a, b, c = (set(spotsigs.signatures(x).tolist()) for x in (text, changed, after))
        ratio = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), ratio(a, b), ratio(a, c)))
    assert got == sorted(want, key=lambda x: (x[0] is None, *map(str, x)))
    assert spotsigs.query(nothing).count() == 0 and spotsigs.query(docs.where("doc_id = 5")).count() == 1


def test_spotsigs_links_are_all_there(docs, rows):
    links, members = spotsigs.near_links(docs)
    found = members.collect()
    assert Counter((r["doc_id"], r["mark"]) for r in found) == Counter((d, spotsigs.to_string(spotsigs.signatures(t))) for d, t, _ in rows)
    mark = {r["class_id"]: r["mark"] for r in found}
    assert len(mark) == len({r["mark"] for r in found})
    sets = {m: {m[i : i + 8] for i in range(0, len(m), 8)} for m in mark.values() if m}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {frozenset((mark[r["a"]], mark[r["b"]])) for r in links.collect()} == want and want


def test_mixing(docs, rows, nothing):
    got = mixing.query(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.query(docs.repartition(7)).collect()))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # sources that are full drop out and the rest is shared anew
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) <= max(200, 0.03 * target[s]) for s in order)
    assert mixing.query(nothing).count() == 0


def test_sainte_lague(spark):
    r = random.Random(6)
    for seats in (0, 1, 7, 100, 1001):
        claims = [r.choice([0, 1, 3, 10, 500]) * r.random() for _ in range(9)] + [5.0, 5.0]
        df = spark.createDataFrame([(i, c, seats) for i, c in enumerate(claims)], "k int, claim double, seats long")
        got = [x["got"] for x in mixing.sainte_lague(df, [], [F.col("k")], "claim", "seats", "got").orderBy("k").collect()]
        want = [0] * len(claims)
        for _ in range(seats):
            i = max(range(len(claims)), key=lambda j: (claims[j] / (2 * want[j] + 1), -j))
            want[i] += 1
        assert got == want


def brute_removed(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        out.append(bytes(cover))
    return out


def test_suffixes(docs, rows, nothing):
    got = by_id(suffixes.query(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    texts = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (doc, _, _), t, c in zip(rows, texts, brute_removed(texts, 400), strict=True):
        want.append((doc, len(t), sum(c), len(re.findall(b"\1+", c)), hashlib.sha256(bytes(x for x, y in zip(t, c, strict=True) if not y)).hexdigest()))
    assert got == sorted(want, key=lambda x: (x[0] is None, *map(str, x)))
    assert suffixes.query(nothing).count() == 0


@pytest.mark.parametrize("hot", [0, 10_000])
@pytest.mark.parametrize("batch", [200, 1 << 18])
def test_short_repeats(spark, monkeypatch, hot, batch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", batch)
    r = random.Random(9)
    blocks = ["".join(r.choice("abcd\0") for _ in range(r.randrange(5, 60))) for _ in range(12)]
    texts = ["".join(r.choice(blocks) if r.random() < 0.7 else "".join(r.choice("ab") for _ in range(9)) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: suffixes.joined_spans(x["spans"]) for x in suffixes.removed(df, suffixes.Unit("bytes", 30, 20), hot=hot).collect()}
    for i, c in enumerate(brute_removed([t.encode() for t in texts], 30)):
        assert got[i] == [m.span() for m in re.finditer(b"\1+", c)]


def test_repeated_passages_of_words(spark, rows, docs):
    """Words in passages of over 50 words that stand anywhere else, by counting all of them."""
    cut = [(t or "").encode().split() for _, t, _ in rows]
    count = Counter(tuple(w[i : i + 51]) for w in cut for i in range(len(w) - 50))
    want = []
    for (doc, _, _), w in zip(rows, cut, strict=True):
        at = {j for i in range(len(w) - 50) if count[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        want.append((doc, len(at)))
    got = by_id(suffixes.query(docs), "passage_words")
    assert got == sorted(want, key=lambda x: (x[0] is None, *map(str, x)))
    assert sum(n > 0 for _, n in got) > 8 and sum(n == 0 for _, n in got) > 20


@pytest.mark.parametrize("unit", [suffixes.Unit("words", 9, 5), suffixes.Unit("bytes", 24, 12)])
def test_short_repeats_of_units(spark, unit):
    r = random.Random(19)
    blocks = [[r.choice("abcdefgh") for _ in range(r.randrange(3, 12))] for _ in range(20)]
    texts = [" ".join(w for _ in range(8) for w in (r.choice(blocks) if r.random() < 0.5 else [str(r.randrange(99)) for _ in range(5)])) for _ in range(50)]
    cut = [unit.of(t).tolist() for t in texts]
    count = Counter(tuple(w[i : i + unit.length]) for w in cut for i in range(len(w) - unit.length + 1))
    got = {x["doc_id"]: suffixes.joined_spans(x["spans"]) for x in suffixes.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), unit).collect()}
    for i, w in enumerate(cut):
        at = {j for k in range(len(w) - unit.length + 1) if count[tuple(w[k : k + unit.length])] > 1 for j in range(k, k + unit.length)}
        assert {j for a, b in got[i] for j in range(a, b)} == at


def test_hashes_of_words(monkeypatch):
    r = random.Random(23)
    words = [bytes(r.randrange(256) for _ in range(r.choice((1, 2, 7, 30, 90)))).translate(None, b" \t\n\r\x0b\x0c") or b"x" for _ in range(300)]
    data = b"".join(r.choice((b" ", b"\n\t ")) + r.choice(words) for _ in range(4000))
    for part in (1 << 16, 64):  # some words are longer than a part
        monkeypatch.setattr(suffixes, "_PART", part)
        for text in (data, data + b" ", data[1:], b"", b" \n", b"word"):
            found, cut = suffixes.word_hashes(text).tolist(), text.split()
            assert len(found) == len(cut)
            assert len(set(zip(found, cut, strict=True))) == len(set(cut)) == len(set(found))
    whole = suffixes.word_hashes(data)
    monkeypatch.setattr(suffixes, "_PART", 1 << 16)
    assert (whole == suffixes.word_hashes(data)).all()


@pytest.mark.parametrize("scan_rows", [suffixes.SCAN_ROWS, 3, 17])
def test_family_merges_geometrically(monkeypatch, scan_rows):
    monkeypatch.setattr(suffixes, "SCAN_ROWS", scan_rows)
    r = random.Random(3)
    parts = [bytes(r.choice(b"ab") for _ in range(40)) for _ in range(90)]
    family = suffixes.Family(12)
    for i in range(0, 90, 6):
        family.add(parts[i : i + 6])
    assert [x.weight for x in family.levels] == [8, 4, 2, 1]
    grams = [p[i : i + 12] for p in parts for i in range(29)]
    many = Counter(grams)
    assert sum(family.marks()) <= sum(many[g] > 1 for g in grams)
    # Every string that occurs once is unmarked, and each repeated one is marked somewhere.
    marked = {g for g, m in zip(grams, family.marks(), strict=True) if m}
    assert marked == {g for g in grams if many[g] > 1}
    for level in family.levels:
        strings = level.strings(np.arange(len(level.order)))
        assert (strings[:-1] <= strings[1:]).all()


def brute_lines(rows):
    keyed = [(d, t, lines.keys_of(t)) for d, t in sorted({(d, t or "") for d, t, _ in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]
    count, owner = Counter(k for _, _, ks in keyed for k in ks), {}
    for i, (_, _, ks) in enumerate(keyed):
        for k in ks:
            owner.setdefault(k, i)
    out = {}
    for i, (d, t, ks) in enumerate(keyed):
        live = {k for k in ks if count[k] > 1 and owner[k] != i}
        gone = set()
        for o in {owner[k] for k in live}:
            own = {k: ks[k] for k in live if owner[k] == o}
            gone |= lines.common_lines(own, {k: keyed[o][2][k] for k in own})
        out[d, t] = sorted(gone)
    return out


def test_lines(docs, rows, nothing):
    want = brute_lines(rows)
    got = lines.query(docs).collect()
    assert len(got) == len(rows)
    sums = Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert sums == Counter((d, len(want[d, t or ""]), hashlib.sha256((lines.kept_text(t, want[d, t or ""]) or "").encode()).hexdigest()) for d, t, _ in rows)
    assert sum(map(len, want.values())) > 10
    assert lines.query(nothing).count() == 0


def test_patience():
    a = [(i, k) for i, k in enumerate("xAyBzzCx")]
    b = [(i, k) for i, k in enumerate("AqBzzCAx")]
    got = lines.patience(a, b)
    assert {(3, 2), (6, 5)} <= set(got) and got == sorted(got) and all(a[i][1] == b[j][1] for i, j in got)
    assert lines.increasing([(0, 5), (1, 1), (2, 2), (3, 0), (4, 9)]) == [(1, 1), (2, 2), (4, 9)]


def test_gaps_without_unique_keys_are_aligned_by_a_longest_common_subsequence():
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(40))] for _ in "ab")
        long = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                long[i + 1][j + 1] = long[i][j] + 1 if x == y else max(long[i][j + 1], long[i + 1][j])
        got = lines.longest_common([(3 * i, k) for i, k in enumerate(a)], [(2 * j, k) for j, k in enumerate(b)])
        assert len(got) == long[-1][-1] and all(a[i // 3] == b[j // 2] for i, j in got)
        assert all(p < q and x < y for (p, x), (q, y) in zip(got, got[1:], strict=False))
    assert lines.patience(list(enumerate("abab")), list(enumerate("xabaybz"))) == [(0, 1), (1, 2), (2, 3), (3, 5)]


def removed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x["doc_id"]: x["gone"] or [] for x in lines.without_shared(df).collect()}


def test_lines_that_occur_twice_in_a_document(spark):
    line, other = "this line of boilerplate stands in all of them", "and a second line that follows it everywhere"
    own = lambda i: "\n".join(f"words of document {i} that no other has, {k}" for k in range(2))
    twice = f"{line}\n{other}\n{own(0)}\n{line}\n{other}"
    got = removed(spark, twice, f"{own(1)}\n{line}\n{other}", f"{line}\n{other}\n{own(2)}\n{line}\n{other}", f"{line}\n{line}\n{line}\n{own(3)}")
    assert len(got.pop(3)) == 2 and got == {0: [], 1: [2, 3], 2: [0, 1, 4, 5]}
    copy = "\n".join([line] * 5)
    assert removed(spark, copy, copy + "\nx")[1] == [0, 1, 2, 3, 4]


def test_blocks_that_changed_places(spark):
    block = lambda n: "\n".join(f"line {i} of the block {n} as all others have it" for i in range(4))
    own = "and a line that only the second one has"
    got = removed(spark, f"{block(1)}\n{block(2)}\n{block(3)}", f"{block(3)}\n{own}\n{block(2)}\n{block(1)}")
    assert got == {0: [], 1: [*range(4), *range(5, 13)]}


def test_common_and_short_lines(spark):
    line = "a line of plain boilerplate that all documents have"
    many = [f"{line}\nthe only other line of document {i} is this" if i % 2 else line for i in range(150)]
    assert removed(spark, *many) == {i: [0] if i else [] for i in range(len(many))}
    verse = [f"so short {i}" for i in range(12)]
    got = removed(spark, "\n".join(verse), "\n".join(["x", *verse[:6], "", *verse[6:], "y"]), "\n".join(["z", *verse[2:4], "z"]))
    assert got == {0: [], 1: [*range(1, 7), *range(8, 14)], 2: []}
    poem = "\n\n".join(verse)
    assert removed(spark, poem, poem) == {0: [], 1: list(range(23))}


def test_pieces(docs, rows, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "")
        want.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((text or "").encode()).hexdigest()))
    want.sort(key=lambda x: (x[0] is None, *map(str, x)))
    assert by_id(pieces.query(docs), "n_tokens", "ids_crc32", "decoded_sha256") == want
    cut = pieces.described(pieces.encode(docs.where("length(text) < 4000 or text is null"), chunk=64))
    assert set(by_id(cut, "n_tokens", "ids_crc32", "decoded_sha256")) <= set(want)
    assert pieces.query(nothing).count() == 0


def test_chunks_meet_anywhere():
    p = pieces._pieces(pieces.model_path())
    r = random.Random(1)
    texts = ["".join(r.choice(["er", "in", "the", "tion", "n", "=", "▁", " ", "\n", "é", "00"]) for _ in range(150)) for _ in range(25)] + [" " * 70, "aaaa" * 40, "🎉é" * 50]
    for text in texts:
        s = pieces.normalised(text)
        for size in (40, 57):
            chunks = [pieces.Chunk(p, s, i, min(i + size, len(s))) for i in range(0, len(s), size)]
            path = pieces.bounds([c.matrix() for c in chunks])
            ids = b"".join(c.ids(*x) for c, x in zip(chunks, path, strict=True))
            assert np.frombuffer(ids, "<u2").tolist() == p.library.encode(text)


def test_scan_is_a_prefix_product():
    items = list("abcdefghijk")
    assert pieces.scan(items, lambda x, y: x + y) == ["abcdefghijk"[: i + 1] for i in range(11)]


def test_registered():
    names = queries.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names
    assert queries.oracle_sql() == {}
