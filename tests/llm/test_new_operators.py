"""Source divergence, packing and ranked search against plain forms, awkward rows included."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fiatscan.llm import divergence, lexical, packing
from fiatscan.llm.terms import term_runs

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
CLASH = ["q", "term", "n", "p", "v", "total", "counts", "sources", "rank", "value", "ids", "start", "length", "offset", "score", "docs", "places", "held"]
DOCS = "doc_id long, text string, lang string, source string"


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdeéßXY", k=rng.randint(1, 4))) + rng.choice(["", "", "1", "22"]) for _ in range(90)]
    some = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=n))
    out = [(i, some(rng.randint(0, 80)), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", None])) for i in range(260)]
    out += [(300, None, "en", "only null"), (301, "", "pl", "alone"), (302, " 12 !? ", "pl", "other"), (None, some(30), "en", "hot"), (None, None, None, None), (5, out[5][1], out[5][2], out[5][3]), (5, "another text of five", "en", "hot")]
    out += [(303, some(30000), "en", "s1"), (304, "x" * 5000, "en", "s1")]
    return out + [(400 + i, out[7][1], "en", "hot") for i in range(80)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def plain_audit(rows, min_docs=10, top=10):
    count, df = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in LETTERS.findall(text or "")]
        groups[lang].add(source)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))  # noqa: B023,E731
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(count[lang, s][t], sum(count[lang, s][k] for k in kept)) for t in kept} for s in sources}
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(apart(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)]
    return sorted(out)


def test_divergence_equals_a_plain_audit(spark, docs, rows, monkeypatch):
    got = divergence.audit(clashing(docs))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain_audit(rows)
    assert sorted(map(tuple, got.collect())) == want and {w[2] for w in want} == {"pair", "term"}
    assert ("pl", "alone", "pair", "other", 0, 1) in want  # no kept term
    assert divergence.audit(docs.limit(0)).count() == 0
    monkeypatch.setattr(divergence, "PART_BYTES", 1000)  # in this process: texts in parts
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "" for r in rows]), pa.array([r[3] or "" for r in rows]), pa.array([(r[1] or "").encode() for r in rows], pa.binary())], ["lang", "source", "text"])
    total, held = Counter(), Counter()
    for part in divergence._partial_counts(iter([batch])):
        for r in part.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
            held[r["lang"], r["source"], r["term"]] += r["docs"]
    plain, plain_held = Counter(), Counter()
    for _, text, lang, source in rows:
        terms = [t.translate(LOWER) for t in LETTERS.findall(text or "")]
        plain.update((lang or "", source or "", t) for t in terms)
        plain_held.update((lang or "", source or "", t) for t in set(terms))
    assert total == plain and held == plain_held


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 9 * 10**15 + 1, 2 * 10**16 + 7, 12345
    got = spark.sql(f"select {divergence.share('n', 'total')} as p from (select {n} as n, {total} as total, {v}L as v)").first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_terms_are_those_of_the_patterns(rows):
    for _, text, *_ in rows:
        for pattern, digits in ((LETTERS, False), (ALNUM, True)):
            from fiatscan.llm.terms import fold_table

            got = [t.decode() for run in term_runs((text or "").encode(), fold_table(digits), 50) for t in run]
            assert got == [t.translate(LOWER) for t in pattern.findall(text or "")]


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def own_ids(text, path):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("length,window", [(1024, 1 << 21), (64, 500), (1, 10)])
def test_packing_keeps_every_id_once_and_pads_nothing(spark, docs, rows, tokenizer, length, window):
    few = docs.where("doc_id is null or doc_id < 40 or doc_id in (300, 301, 303)").cache()
    got = packing.pack_documents(clashing(few), tokenizer, length, window=window).collect()
    want = Counter((r.doc_id, zlib.crc32(np.array(own_ids(r.text, tokenizer), "<u4").tobytes())) for r in few.collect())
    if window > 500:  # then each document is in one place of the result, in order of its starts
        by = defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        for doc_id, n in Counter(k for k, _ in want.elements()).items():
            if n == 1:
                own = sorted(by[doc_id], key=lambda r: r.start)
                assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == own[0].doc_tokens
                assert (doc_id, zlib.crc32(b"".join(bytes(r.ids) for r in own))) in want
    assert sum(r.length for r in got) == sum(len(own_ids(r.text, tokenizer)) for r in few.collect())
    sequences = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        size = sum(r.length for r in own)
        assert size <= length and size & (size - 1) == 0
        assert own[0].sequence_cost == sum(packing.cost(r.length) for r in own)
    whole = packing.sequences(spark.createDataFrame(got)).collect()
    assert len(whole) == len(sequences) and all(len(r.ids) == 4 * sum(r.lengths) for r in whole)
    assert packing.pack_documents(docs.limit(0), tokenizer).count() == 0


def test_packing_refuses_lengths_that_would_pad(docs, tokenizer):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack_documents(docs, tokenizer, 1000)


def plain_packing(sizes, rooms, linear):
    """The rule as it is said: by falling cost, to the lightest sequence with room; where there is none, the lightest open one is filled."""
    held = [[room, 0, []] for room in rooms]
    for k, size in sorted(enumerate(sizes), key=lambda x: -x[1]):
        while size:
            fits = [s for s in held if s[0] >= size] or [s for s in held if s[0] > 0]
            if not fits:
                break
            s = min(fits, key=lambda s: s[1])
            n = min(size, s[0])
            s[0], s[1], size = s[0] - n, s[1] + packing.cost(n, linear), size - n
            s[2].append((k, n))
    return [s[2] for s in held], [s[1] for s in held]


@pytest.mark.parametrize("seed", range(6))
def test_sequences_get_equal_costs(seed):
    rng = random.Random(seed)
    sizes = [min(1023, int(rng.expovariate(1 / 200)) + 1) for _ in range(400)]
    full, odd = divmod(sum(sizes), 1024)
    rooms = [1024] * full + packing.powers(odd)
    pieces = [packing.Piece(k, np.zeros(n, np.uint32), 0, n) for k, n in enumerate(sizes)]
    got, left = packing.balanced(pieces, rooms, 0, 500)
    want, costs = plain_packing(sizes, rooms, 500)
    assert not left and [[(p.doc_id, len(p.ids)) for p in s.pieces] for s in got] == want
    assert [s.cost for s in got] == costs and all(s.room == 0 for s in got)
    in_turn, at = [], 0  # the same ids, one after another
    for room in rooms:
        total, n = 0, room
        while n:
            take = min(n, sizes[at] if at < len(sizes) else n)
            total, n = total + packing.cost(take, 500), n - take
            at += 1
        in_turn.append(total)
    assert np.std(costs[:full]) < np.std(in_turn[:full])
    half, rest = packing.balanced(pieces, [1024] * (full // 2), 0, 500)
    assert all(s.room == 0 for s in half) and sum(len(p.ids) for p in rest) == sum(sizes) - 1024 * (full // 2)


def plain_search(rows, items, top=10):
    held = [(i, Counter(t.translate(LOWER) for t in ALNUM.findall(text or ""))) for i, text, *_ in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    out = []
    for item, text in items:
        asked = Counter(t.translate(LOWER) for t in ALNUM.findall(text or ""))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in held) + 1))) for t in asked}
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(r * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items())
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(3)
    texts = [" ".join((rows[k][1] or "").split(" ")[2:12]) for k in range(0, 60, 3)]
    return [*enumerate(texts), (100, None), (101, ""), (102, "!!"), (103, "nowhere0"), (None, rows[8][1]), (4, texts[4]), (104, " ".join([rng.choice("abc") for _ in range(5000)])), (105, "x" * 5000)]


@pytest.mark.parametrize("shard_docs,vocabulary,entries", [(16384, 500_000, 2_000_000), (50, 40, 25)])
def test_search_equals_scoring_all(spark, docs, rows, items, shard_docs, vocabulary, entries):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(clashing(docs), clashing(table), vocabulary=vocabulary, entries=entries, shard_docs=shard_docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, items)
    if shard_docs == 50:
        assert lexical.search(docs.limit(0), table).count() == 0 and lexical.search(docs, table.limit(0)).count() == 0


def best_cut(values, most):
    price = sum(values) // len(values)
    best = [0] + [None] * len(values)
    for j in range(1, len(values) + 1):
        best[j] = min(best[i] + (j - i) * max(values[i:j]) + price for i in range(max(0, j - most), j))
    return best[-1]


def test_blocks_have_the_least_summed_error():
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 1000, n).astype(np.int32) for n in (1, 2, 7, 90, 40, 300)] + [np.full(70, 9, np.int32)]
    lengths = np.array([len(x) for x in lists])
    for most in (4, 64):
        sizes, blocks = lexical.cut_lists(np.concatenate(lists), lengths, most)
        assert sizes.max() <= most and len(set(sizes.tolist())) > 1 and blocks.sum() == len(sizes)
        at = 0
        for x, n in zip(lists, blocks):
            own, at = sizes[at : at + n], at + n
            parts = np.split(x, np.cumsum(own)[:-1])
            assert sum(own) == len(x) and sum(len(p) * int(p.max()) for p in parts) + n * (int(x.sum()) // len(x)) == best_cut(x.tolist(), most)


def test_blocks_are_skipped():
    """Most documents of a shard have no chance against ten good ones, so most postings are not read."""
    rng = np.random.default_rng(6)
    n, n_terms = 4000, 12
    places, values, lengths = [], [], []
    for _ in range(n_terms):
        own = np.sort(rng.choice(n, 1500, replace=False)).astype(np.int32)
        places.append(own)
        values.append(np.where(own < 40, 5000, rng.integers(1, 50, len(own))).astype(np.int32))
        lengths.append(len(own))
    p, x = np.concatenate(places), np.concatenate(values)
    sizes, blocks = lexical.cut_lists(x, np.array(lengths))
    shard = lexical.Shard(list(range(n)), np.arange(n_terms, dtype=np.int32), np.array(lengths), blocks, p, x, sizes, np.maximum.reduceat(x, np.cumsum(sizes) - sizes))
    best = shard.search(np.arange(n_terms), np.full(n_terms, 3), np.zeros((0, 2), np.int64), 10)
    total = np.zeros(n, np.int64)
    np.add.at(total, p, 3 * x.astype(np.int64))
    want = sorted(range(n), key=lambda d: (-total[d], d))[:10]
    assert best[:, 1].tolist() == want and best[:, 0].tolist() == total[want].tolist()
    assert shard.read < 0.2 * len(p)
