"""Each operator against brute force on small tables, awkward rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fiatscan.llm import ann, decontaminate, html_text, language, line_dedup, mixing, near_dedup, quality, sharding, token_records

SPACED = re.compile(r"[^\x20\x09-\x0d]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
CLASH = ["_id", "_text", "_score", "shard", "slot", "curve", "key", "node", "kept", "score", "owner", "_h", "_digest", "law", "size", "taken", "n_tokens", "domain"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SF = "/root/testdata/sf0.01"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(120):
        text = words(rng, rng.randint(0, 60)).replace(" b", ".\nB")
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src5", None]), len(text)))
    base = words(rng, 80).split()
    for i in range(120, 170):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = "x" + str(rng.randint(0, 99))
        out.append((i, " ".join(copy), "en", "src0", 1))
    out += [(170, None, None, None, None), (171, "", "en", "src1", 0), (172, " \t ", "de", "src2", 3), (None, "no id here at all\nno id here at all", "en", "src0", 5), (173, out[3][1], "en", "src9", 2), (5, out[5][1], out[5][2], out[5][3], out[5][4])]
    out += [(174, words(rng, 20000), "en", "src0", 0), (175, "!!! ... 123", "en", "src3", 0), (176, "A shared line of text\nB  b\n  a SHARED line of text \n", "en", "src3", 0), (177, "a shared line of text", "en", "src3", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def clashing(df, skip=()):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in CLASH if c not in skip})


def test_hilbert_curve_steps_to_neighbours(spark):
    from pyspark.sql import functions as F

    grid = spark.range(16**3).selectExpr("cast(id % 16 as int) a", "cast(id div 16 % 16 as int) b", "cast(id div 256 as int) c")
    found = grid.select("a", "b", "c", sharding.hilbert_index([F.col(x) for x in "abc"]).alias("h")).orderBy("h").collect()
    assert [r.h for r in found] == list(range(16**3))
    assert all(abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) == 1 for p, q in zip(found, found[1:]))


def test_shards_are_even_and_gapless(spark, docs, rows):
    got = sharding.shard_documents(clashing(docs)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(order, order[1:])) and all(r.law == "rows" and r.grown_shard is None for r in got)
    zones = {z.shard: z for z in sharding.zone_map(sharding.shard_documents(docs), ["size"]).collect()}
    assert all(zones[r.shard]["min_size"] <= r["size"] <= zones[r.shard]["max_size"] for r in got)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_shards_are_skipped_by_every_dimension(spark, tmp_path):
    """Files of 64 shards: a filter on any dimension must leave most of them unread, by their bounds, and find all its rows in the rest."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, "x" * int(2 ** rng.uniform(0, 15)), rng.choice(["de", "en", "fr", "pl", "sv", None]), f"site{rng.randint(0, 40):02d}", 0) for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 64)
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(got, path)
    back = spark.read.parquet(path).cache()
    assert back.count() == len(rows) and len(list(tmp_path.glob("shards/shard=*"))) == 64
    zones = sharding.zone_map(back, ["source", "lang", "size"]).cache()
    for column, value in (("source", "site07"), ("lang", "fr"), ("size", 20)):
        read = {z.shard for z in zones.where((F.col(f"min_{column}") <= value) & (F.col(f"max_{column}") >= value)).collect()}
        holding = {r.shard for r in back.where(F.col(column) == value).select("shard").distinct().collect()}
        assert holding <= read and len(read) <= 32, (column, len(read))
    for shard in (0, 17, 63):
        curves = [r.curve for r in spark.read.parquet(f"{path}/shard={shard}").orderBy("slot").collect()]
        assert curves == sorted(curves)


def test_quality_learns_and_scores_all(spark):
    rng = random.Random(1)
    good = ["the quick brown fox jumps over the lazy dog and runs " + words(rng, 60) for _ in range(300)]
    bad = ["BUY!! NOW!! %%% $$$ " + words(rng, 60).upper().replace(" ", "!! ") for _ in range(300)]
    data = [(i, t) for i, t in enumerate(good + bad)] + [(None, good[0]), (9000, None), (9001, ""), (9002, bad[0] * 400), (3, good[3])]
    table = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 300 else 0, 0) for i in range(600)] + [(3, 0, 0), (None, 1, 0), (9000, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(clashing(table), labels).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id < 300) for r in held]) > 0.97
    assert [r.predicted for r in got if r.doc_id == 9002] == [0]
    assert {r.score for r in quality.classify(table, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(table.limit(0), labels).count() == 0


def test_quality_scores_equal_plain_python(spark):
    """Every document of the small table, scored block by block without the operator's scoring code."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert model.fitted
    plain = {"level": quality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    good, bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in model.dictionaries)
    none = zstandard.ZstdCompressor(**plain)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        sums, apart = [0, 0, 0], []
        for at in range(0, len(data), 512):
            block = data[at : at + 512]
            sizes = [len(c.compress(block)) for c in (good, bad, none)]
            sums = [a + b for a, b in zip(sums, sizes)]
            apart.append((sizes[0] - sizes[1]) / len(block))
        x = [(sums[0] - sums[1]) / len(data), *(v / len(data) for v in sums), max(apart), min(apart)] if data else [0.0] * 6
        z = model.weights[-1] + sum((v - m) / c * w for v, m, c, w in zip(x, model.mean, model.scale, model.weights))
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == (score >= 0.3) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_scores_equal_a_loop_over_bytes(spark):
    """Both directions, a byte and a gate at a time, against the batched passes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    w, n = {k: v.astype(float) for k, v in model.weights.items()}, language.HIDDEN
    texts = [r.text for r in docs.where("length(text) < 600").limit(25).collect()] + ["é", "a\0b", "Ein Satz."]

    def run(codes, table, u):
        h, out = np.zeros(n), []
        for c in codes:
            new = np.zeros(n)
            for k in range(n):
                z = min(1.0, max(0.0, 0.25 * (table[c, k] + sum(h * u[:, k])) + 0.5))
                r = min(1.0, max(0.0, 0.25 * (table[c, n + k] + sum(h * u[:, n + k])) + 0.5))
                new[k] = (1 - z) * np.tanh(table[c, 2 * n + k] + r * sum(h * u[:, 2 * n + k])) + z * h[k]
            h = new
            out.append(h)
        return out

    names, scores = language.predict(texts, model)
    for text, name, score in zip(texts, names, scores):
        data, total = text.encode().replace(b"\0", b"\1"), np.zeros(len(model.languages))
        for at in range(0, len(data), language.WINDOW):
            codes = list(data[at : at + language.WINDOW])
            padded = codes + [0] * (language.WINDOW - len(codes))
            ahead, astern = run(padded, w["xf"], w["uf"]), run(padded[::-1], w["xb"], w["ub"])[::-1]
            for t in range(len(codes)):
                p = np.exp(np.concatenate([ahead[t], astern[t]]) @ w["o"] + w["c"])
                total += p / p.sum()
        total /= len(data)
        assert model.languages[total.argmax()] == name and abs(total.max() - score) < 1e-4


def components(nodes, links):
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [64, 4])
def test_near_duplicates_equal_all_pairs(docs, rows, block):
    named = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    links = [(a, b) for k, (a, s) in enumerate(named) for b, u in named[:k] if a != b and s and u and 100 * len(s & u) >= 85 * len(s | u)]
    held = components({i for i, _ in named}, links)
    want = Counter((i, len(shingles(t)), held.get(i), i is None or held[i] == i) for i, t, *_ in rows)
    got = near_dedup.near_duplicates(clashing(docs), block=block).collect()
    assert Counter(tuple(r) for r in got) == want
    assert len({c for i, c in held.items()}) < len(held)


def test_groups_of_near_copies_need_no_blocks(spark, monkeypatch):
    """A large group is linked by its star, dealt to several tasks; only what a bucket holds of another group goes into blocks."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(240)]
    texts = [" ".join(f"x{n}" if k == at else w for k, w in enumerate(base)) for n, at in enumerate(rng.choices(range(240), k=300))]
    odd = [" ".join(base[:140] + [f"y{n}{k}" for k in range(100)]) for n in range(5)]
    table = spark.createDataFrame(list(enumerate(texts + odd + [texts[0]] * 40)), "doc_id long, text string")
    seen, whole = [], near_dedup.block_links

    def spied(sets, members, *more):
        seen.append((members.count(), members.select("component").distinct().count()))
        return whole(sets, members, *more)

    monkeypatch.setattr(near_dedup, "block_links", spied)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, star_block=32, block=8, block_limit=16).collect()}
    assert {got[i] for i in [*range(300), *range(305, 345)]} == {0} and [got[i] for i in range(300, 305)] == list(range(300, 305))
    assert near_dedup.near_duplicates(table.where("doc_id < 300"), star_block=32).where("component_id <> 0").count() == 0
    assert seen[1] == (0, 0)


def test_near_duplicates_of_nothing(docs):
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert [r.kept for r in near_dedup.near_duplicates(docs.where("doc_id = 170")).collect()] == [True]


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 1500, np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[500:])
    x, y = near_dedup.signature(a, 1024), near_dedup.signature(b, 1024)
    assert abs((x == y).mean() - 500 / 1500) < 0.05


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


@pytest.mark.parametrize("batches,fanin", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup_keeps_the_smallest_owner(docs, rows, batches, fanin):
    big = 1 << 62
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(big if i is None else i)
    want = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(line_key(x)) >= 10 and len(holders[line_key(x)]) > 1 and min(holders[line_key(x)]) != (big if i is None else i))]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = line_dedup.dedup_lines(clashing(docs), batches, fanin).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_dropped for r in got) > 3


def test_line_dedup_of_nothing(docs):
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_gru_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    w = {k: rng.normal(0, 0.5, s) for k, s in {"xf": (256, 6), "uf": (2, 6), "xb": (256, 6), "ub": (2, 6), "o": (4, 3), "c": (3,)}.items()}
    codes, labels = rng.integers(0, 5, (7, 9)).astype(np.uint8), rng.integers(0, 3, 7)
    _, g = language.gradients(codes, labels, w)
    for k in w:
        at = tuple(rng.integers(0, s) for s in w[k].shape) if k[0] != "x" else (int(codes[0, 0]), 3)
        sides = []
        for step in (1e-6, -2e-6):
            w[k][at] += step
            sides.append(language.gradients(codes, labels, w)[0])
        w[k][at] += 1e-6
        assert abs((sides[0] - sides[1]) / 2e-6 - g[k][at]) < 1e-7


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    stems = {"en": ["the", "thing", "and", "with", "over", "house"], "de": ["der", "schön", "und", "über", "nicht", "haus"]}
    data = [(i, " ".join(rng.choices(stems[lang], k=40)), lang, "s") for i, lang in enumerate(rng.choices(["en", "de"], k=400))]
    odd = [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "123 !!", None, None), (None, "the thing and the house", "en", "s"), (1003, "der und über haus " * 3000, None, "s"), (1004, "the\0thing and", "en", "s")]
    table = spark.createDataFrame(data + odd, "doc_id long, text string, lang string, source string")
    got = language.identify(clashing(table)).collect()
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 for r in got)
    true = {i: lang for i, _, lang, _ in data}
    held = [r for r in got if r.held_out and r.doc_id in true]
    assert {r.doc_id for r in held} == {i for i in true if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.97
    named = {r.doc_id: r.lang_pred for r in got}
    assert [named[i] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert language.identify(table.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(table.withColumn("lang", table["lang"].substr(9, 1).cast("string")).where("doc_id = 1000")).collect()} == {"und"}


def test_every_language_is_learned(spark):
    long = "der schön und über nicht haus " * 800
    few = [(i, long, "de", "s") for i in range(12)] + [(100 + i, "the thing and with over house " * 5, "en", "s") for i in range(12)]
    many = [(1000 + i, f"text {i}", f"l{i // 8}", "s") for i in range(8 * 600)]
    table = spark.createDataFrame(few + many, "doc_id long, text string, lang string, source string")
    learned = {lang for i, _, lang, _ in few + many if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(language.train(table).languages) == learned and len(learned) > 590
    got = language.identify(table.where("lang in ('de', 'en')")).collect()
    assert all(r.lang_pred == ("de" if r.doc_id < 100 else "en") for r in got)


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_pieces_equal_the_library(tokenizer_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path)
    plain.encode_special_tokens = True
    rng = random.Random(3)
    odd = ["a", "B", "é", " ", "  ", "\n", "\t", "\xa0", "1", "22", ".", "!", "'s", "<|endoftext|>", "中", "​", "\x85", "\r", "it's", "\x1f", "\x00", ", ", "?"]
    for alphabet in (odd, ["a", "bc", "é", " ", " ", "\n", ".", "d's"]):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
        assert token_records.encode_texts(texts, tokenizer_path) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_records_hold_added_tokens_as_the_library_does(spark, tokenizer_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path)
    rng = random.Random(4)
    parts = ["a", "end", " ", " ", "  ", "\n", "é", "<|endoftext|>", "<|endof", "text|>", "."]
    texts = ["end <|endoftext|> next", "<|endoftext|>", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    ids = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [437, 220, 50256, 1306]
    assert token_records.encode_texts(texts, tokenizer_path, special=True) == [np.array(i, "<u4").tobytes() for i in ids]
    table = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    got = sorted(token_records.encode_documents(table, tokenizer_path).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())) for i in ids[:40]]


def test_records_round_trip(spark, docs, rows, tokenizer_path, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path)
    path = f"file://{tmp_path}/records"
    got = sorted(token_records.encode_documents(clashing(docs), tokenizer_path, path).collect(), key=lambda r: r.start)
    want = sorted(((i is None, i or 0), t or "") for i, t, *_ in rows)
    start = 0
    for r, ((_, doc_id), text) in zip(got, want, strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = got[17]
    with open(some.path.removeprefix("file:"), "rb") as f:
        f.seek(some.offset)
        payload, end = token_records.unframe(f.read(some.length))
    assert end == some.length and token_records.parse(payload)[0] == some.doc_id
    broken = bytearray(token_records.frame(payload) + b"\n")
    broken[20] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(bytes(broken))
    with pytest.raises(ValueError):
        token_records.unframe(bytes(broken[:9]))
    assert token_records.encode_documents(docs.limit(0), tokenizer_path).count() == 0


def test_records_roll_over_many_files(spark, docs, rows, tokenizer_path):
    """A few bytes a file and a hot row: many files, read back in order, with the same records as one big file's."""
    hot = spark.createDataFrame([(5, "the same text again", "en", "s", 0)] * 400, SCHEMA)
    both = docs.unionByName(hot)
    few = [tuple(r)[:4] for r in token_records.encode_documents(both, tokenizer_path).orderBy("start").collect()]
    many = token_records.encode_documents(both, tokenizer_path, file_bytes=2000).orderBy("start").collect()
    names = {r.path for r in many}
    assert len(names) > 20 and len({r.path for r in many if r.doc_id == 5}) > 5
    assert Counter((r[0], *r[2:]) for r in few) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in many)
    ids = [r.doc_id for r in many if r.doc_id is not None]
    assert ids == sorted(ids) and [r.start for r in many] == np.cumsum([0, *(r.n_tokens for r in many)])[:-1].tolist()
    order = spark.createDataFrame([("f:/a/part-100000-x-c000.txt",), ("f:/a/part-99999-x-c001.txt",), ("f:/a/part-99999-x-c000.txt",)], "p string")
    assert [r.p[10:] for r in order.orderBy(token_records.file_order(order["p"])).collect()] == ["99999-x-c000.txt", "99999-x-c001.txt", "100000-x-c000.txt"]


def test_pieces_survive_a_small_store_and_other_tokenizers(tokenizer_path, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefg.,") for _ in range(rng.randint(1, 6))) for _ in range(200)) for _ in range(60)]
    monkeypatch.setattr(token_records, "STORE_PIECES", 300)
    for path in (tokenizer_path, pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")):
        token_records._ENCODERS.clear()
        plain = Tokenizer.from_file(path)
        assert token_records.encode_texts(texts, path, special=True) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert token_records._encoder(path, True)[3] is None
    token_records._ENCODERS.clear()


def fill(children, budget):
    """Integer water-filling among (name, weight, cap): the model of one node."""
    budget, share, open_ = min(budget, sum(c for _, w, c in children if w)), {}, sorted((n, w, c) for n, w, c in children if w)
    while True:
        total = sum(w for _, w, _ in open_)
        full = [(n, w, c) for n, w, c in open_ if c * total <= budget * w]
        if not full:
            break
        least = min(full, key=lambda x: (x[2] / x[1], x[0]))
        share[least[0]] = least[2]
        budget -= least[2]
        open_.remove(least)
        if not open_:
            break
    left, parts = budget, {n: budget * w // sum(x[1] for x in open_) for n, w, _ in open_}
    left -= sum(parts.values())
    for k, n in enumerate(sorted(parts)):
        share[n] = parts[n] + (k < left)
    return {n: share.get(n, 0) for n, _, _ in children}


def test_mixing_follows_the_tree(docs, rows):
    got = mixing.mix(clashing(docs, ("domain",))).collect()
    leaf = lambda r: (r.domain, r.lang, r.source)
    tokens = Counter()
    for r in got:
        tokens[leaf(r)] += r.n_tokens
    assert sum(tokens.values()) == sum(len(SPACED.findall(t or "")) for _, t, *_ in rows)
    weight = lambda level, n: mixing.WEIGHTS[mixing.LEVELS[level]].get(n, 1)

    def down(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        names = sorted({k[len(prefix)] for k in tokens if k[: len(prefix)] == prefix})
        caps = {n: 2 * sum(v for k, v in tokens.items() if k[: len(prefix) + 1] == (*prefix, n)) for n in names}
        shares = fill([(n, weight(len(prefix), n), caps[n]) for n in names], budget)
        return {k: v for n in names for k, v in down((*prefix, n), shares[n]).items()}

    want = down((), sum(tokens.values()) * 60 // 100)
    digest = {np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64).item() if t is not None else 42: hashlib.md5((t or "").encode()).hexdigest() for _, t, *_ in rows}
    taken = Counter()
    for r in got:
        taken[leaf(r)] += r.taken
        assert r.taken == r.full_epochs * r.n_tokens + r.partial_tokens and 0 <= r.partial_tokens <= r.n_tokens
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in taken.items() if v}
    for k in tokens:
        order = sorted((r for r in got if leaf(r) == k and r.n_tokens), key=lambda r: hashlib.md5(f"{mixing.SEED}-{r.full_epochs}-{'' if r.doc_id is None else r.doc_id}-{digest[r.text_hash]}".encode()).hexdigest())
        states = [0 if r.partial_tokens == r.n_tokens else 1 if r.partial_tokens else 2 for r in order]
        assert states == sorted(states) and states.count(1) <= 1
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_decontamination_equals_brute_force(spark, docs, rows, limit):
    rng = random.Random(5)
    items = [(1, rows[130][1]), (2, " ".join((rows[20][1] or "").split()[3:8])), (3, "a"), (4, None), (5, " -- "), (5, rows[174 if len(rows) > 174 else 0][1][:300]), (None, " ".join(SPACED.findall(rows[-4][1])[500:520])), (7, rows[130][1]), (8, words(rng, 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").encode().lower())
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    want = Counter()
    for i, t, *_ in rows:
        w, hit, met = ALNUM.findall((t or "").encode().lower()), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    met |= found
        names = sorted(str(x) for x in met if x is not None)
        want[i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate.contamination(clashing(docs), clashing(bench), broadcast_limit=limit).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


def test_decontamination_of_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(docs, bench).collect()} == {False}
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="row-%d"><div class="content post-%d"><h2>Title &amp; more&nbsp;x</h2><p>Para one <b>bold</b> text of %d words<br>line two.</p><!-- c --><p>Second <a href="q">link</a> para with a > b &lt;tag&gt;.
<ul><li>item one<li>item two</ul><div class="ad-box ad">Buy now</div><script>var a="<p>no</p>"</script><div class="share-buttons">Share</div></div>
<aside>side stuff here long long long long</aside><section id="comments"><p>Comment by a reader which is long enough</p></section></div><div class="cookie-notice">We use cookies</div><form>Name</form><footer>foot</footer></body></html>"""
TEXT = "Title & more x\nPara one bold text of %d words line two.\nSecond link para with a > b <tag>.\nitem one\nitem two"


def test_pages_of_a_host_share_their_paths(spark):
    data = [(i, f"http://Host.example/{i}?x", PAGE % (i, i, i)) for i in range(30)]
    short = '<html><body><div class="row-1"><div class="content post-9"><p>Short.</p></div><div class="extra"><p>' + "A longer box of text beside the article, about other things. " * 4 + "</p></div></div></body></html>"
    odd = [(100, None, PAGE % (1, 1, 1)), (101, "http://host.example/", None), (102, "nonsense", ""), (103, "http://host.example/s", short), (104, "http://lone.example/", "<p>Only <i>text</i>"), (105, "http://lone.example/", "plain &copy; text < 5"), (None, "http://host.example/2", (PAGE % (2, 2, 2))[:500]), (0, data[0][1], data[0][2])]
    pages = spark.createDataFrame(data + odd, "page_id long, url string, html string")
    for limit in (100_000, 0):
        got = html_text.extract_pages(clashing(pages), limit).collect()
        assert len(got) == len(data) + len(odd) and all(r.n_chars == len(r.text) for r in got)
        text = {r.page_id: r.text for r in got}
        assert all(text[i] == TEXT % i for i in range(30)) and text[100] == TEXT % 1
        assert (text[101], text[102], text[103], text[104], text[105]) == ("", "", "Short.", "Only text", "plain © text < 5")
        assert text[None].startswith("Title & more x\nPara one")
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_classes_that_hide_everything_are_overruled():
    source = "<body><div class=sidebar-layout><article><p>Some text.</p></article></div></body>"
    assert html_text.extract(source, []) == "Some text."
    source = """<body><main><article class="post has-sidebar"><h1>T</h1><p>The text.</p><p style="display: none">Hidden</p><p hidden>Hidden</p><span aria-hidden=true>shown inline</span></article>
    <article class="comment-body"><p>A comment.</p></article><div role="contentinfo">Imprint</div></main></body>"""
    assert html_text.extract(source, []) == "T\nThe text.\nshown inline"


@pytest.mark.parametrize("name", ["wrap has-sidebar", "no-sidebar", "ad-free", "market-share", "header-fixed", "sidebar-layout", "withSidebar"])
def test_wrappers_with_noise_words_keep_the_article(name):
    skip, body = "<div class=skip>Skip to content</div>", "<h1>T</h1><p>The text of the article, all of it.</p><div class=share>Share</div>"
    for inner in (f"<div class=post>{body}</div>", f"<article>{body}</article>"):
        source = f"<body>{skip}<div class='{name}'>{inner}</div></body>"
        assert html_text.extract(source, []) == "T\nThe text of the article, all of it."
        assert max(html_text.votes(source).items(), key=lambda x: x[1])[0].endswith(("/div.post", "/article"))
    long = "<div id=comments><p>" + "A long comment. " * 40 + "</p></div>"
    assert html_text.extract(f"<body><article>{body}{long}</article></body>", []) == "T\nThe text of the article, all of it."


def test_parts_outside_the_largest_container_are_kept():
    long = "".join(f"<p>Paragraph {k} of the article, with some text.</p>" for k in range(12))
    want = [f"Paragraph {k} of the article, with some text." for k in range(12)]
    beside = "<div class=extra><p>Other things in a box beside the article.</p></div><div class=links><a href=x>One</a> <a href=y>Two</a></div>"
    for post in ("<div class=post>%s</div>", "<table><tr><td class=post>%s</td></tr></table>", "<section>%s</section>"):
        inner = f"<h1>Title</h1><p>Lead</p><div class=post-body>{long}</div><section class=end><p>The end.</p></section>"
        page = f"<body><div class=row>{post % inner}{beside}</div></body>"
        path = max(html_text.votes(page).items(), key=lambda x: x[1])[0]
        assert path.endswith("/div.post-body")
        assert html_text.extract(page, [path]).split("\n") == ["Title", "Lead", *want, "The end."]
    only_end = f"<body><div class=post><div class=post-body>{long}</div><section><p>The end.</p></section></div>{beside}</body>"
    assert html_text.extract(only_end, []).split("\n") == [*want, "The end."]
    headed = f"<body><div class=post><div class=top><h1>Title</h1></div><div class=post-body>{long}</div></div>{beside}</body>"
    assert html_text.extract(headed, []).split("\n") == ["Title", *want]


def test_titles_leads_and_odd_class_names_are_text():
    long = "".join(f"<p>Paragraph {k} of the article, with some text.</p>" for k in range(12))
    want = [f"Paragraph {k} of the article, with some text." for k in range(12)]
    lead = f"<body><div class=row><div class=lead><p>The lead.</p></div><div class=body>{long}</div><div class=extra><p>Other things.</p></div></div></body>"
    assert html_text.extract(lead, []).split("\n") == ["The lead.", *want]
    titled = f"<body><header>Site</header><article><header><h1>Title</h1></header>{long}<footer>Filed under x</footer></article></body>"
    assert html_text.extract(titled, []).split("\n") == ["Title", *want]
    odd = "<section class=related-work><p>Related work.</p></section><p class=notice-period>Notice.</p><p class=story-search>Search.</p>"
    noise = "<div class=share-buttons>Share</div><div class=related-posts>More</div><p class=ad>Buy</p><div class=post-comments>Hello</div><ul class=site-nav><li>Menu</ul>"
    for post in ("<article>%s</article>", "<div class=content>%s</div>"):
        page = f"<body>{post % (long + odd + noise)}<div class=story-notice><p>Outside.</p></div></body>"
        assert html_text.extract(page, []).split("\n") == [*want, "Related work.", "Notice.", "Search."]


@pytest.mark.parametrize("listed", [1, 16])
def test_pages_equal_a_consensus_without_spark(spark, listed):
    """Votes added up in plain Python, and each page read on its strongest path of all, against the query on the small table and odd pages."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").limit(150).collect()]
    body = "".join(f"<p>Some words of paragraph {k}, all text.</p>" for k in range(9))
    rows += [(90000 + k, f"https://many.example/{k}", f"<body><div class=t{'abcdefgh'[k % 8]}>{body}</div><div class=u{'xy'[k % 2]}>{body[: 90 * (k % 5)]}</div></body>") for k in range(60)]
    rows += [(95000, "https://many.example/x", "<body><div class=late>" + body * 400 + "</div></body>"), (95001, None, "<p>x"), (95002, "https://many.example/y", None), rows[-1]]
    total = {}
    for _, url, page in rows:
        host = (re.search(r"//([^/:?#]+)", url or "") or [None, ""])[1].lower()
        for path, n in html_text.votes(page).items():
            total[host, path] = total.get((host, path), 0) + n
    want = []
    for page_id, url, page in rows:
        host = (re.search(r"//([^/:?#]+)", url or "") or [None, ""])[1].lower()
        ranked = sorted((p for h, p in total if h == host), key=lambda p: (-total[host, p], p))
        want.append((page_id, html_text.extract(page, ranked)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (100_000, 0):
        got = [(r.page_id, r.text) for r in html_text.extract_pages(pages, limit, listed).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_fallbacks_are_text_and_unclosed_skips_end():
    assert html_text.extract("<p>Let <math><mi>x</mi></math> be <object data=q>a plot</object>.</p>", []) == "Let x be a plot."
    assert html_text.extract("<div><svg><path d=q><p>One.</p><p>Two.</p></div>", []) == "One.\nTwo."
    assert html_text.extract("<div><noscript><p>Enable it</p></noscript><p>One.</p></div>", []) == "One."


@pytest.mark.parametrize("n,spread", [(3000, 0.7), (9000, 0.3)])
def test_nearest_neighbours(spark, n, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(n // 150, 24))
    x = (centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, 24))).astype(np.float32) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)
    x[100:900] = x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(n + 1000, None), (n + 1001, [0.0] * 24), (n + 1020, [float("nan")] * 24), (n + 1040, [1.0] * 5), (n + 1060, [None] * 24), (n + 1080, [float("inf")] * 24), (None, x[0].tolist()), (0, x[0].tolist())]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(clashing(table), block=700).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    y = x.astype(np.float64)
    queries = range(0, n, 20)
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        s = y @ y[q]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(n), -np.round(s, 9)))[:20].tolist())
        assert [r.rank for r in got[q]] == list(range(1, 21)) and q not in {r.vec_id for r in got[q]}
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in got[q])
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(got[q], got[q][1:]))
        hits += len(want & {r.vec_id for r in got[q]})
    assert hits / (20 * len(queries)) > 0.95
    if n == 3000:
        assert len(ann.nearest(table.where("vec_id in (20, 21, 22)")).collect()) == 2
        assert ann.nearest(table.limit(0)).count() == 0 and ann.nearest(table.where(f"vec_id = {n + 1001}")).count() == 0


def clusters(n=6000, dims=24, of=60, spread=0.15):
    """Unit vectors in close clusters."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n // of, dims))[rng.integers(0, n // of, n)] + spread * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_candidates_come_from_the_indices_alone(spark):
    x = clusters(spread=0.25)
    coder = ann.learn(x[:2000], 1.0, len(x))
    assert coder.substrings > 1
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c long, embedding array<double>")
    shared = spark.sparkContext.broadcast(coder)
    index = ann.index_table(classes, shared, False, "c", "code").cache()
    probes = ann.index_table(classes.where("c % 20 = 0"), shared, True, "q", "asked").cache()
    found = {(r.q, r.c): r.apart for r in ann.met(index, probes).distinct().collect()}
    sides, asked = ann.projected(x, coder), ann.projected_queries(x[::20], coder)
    held, looked = ann.values(sides, coder), ann.probe_values(asked, coder)
    want = {(20 * q, c) for q in range(len(asked)) for k in range(coder.substrings) for c in np.flatnonzero(np.isin(held[:, k], looked[q, k])).tolist()}
    assert set(found) == want and len(want) < 0.1 * len(asked) * len(x)
    apart = np.bitwise_count(ann.words(asked)[:, None, :] ^ ann.words(sides)[None]).sum(2)
    assert all(apart[q // 20, c] == n for (q, c), n in found.items())
    pigeonhole = {(20 * int(q), int(c)) for q, c in np.argwhere(apart <= 2 * coder.substrings - 1)}
    assert pigeonhole and pigeonhole <= want
    first = index.where(f"bucket < {1 << coder.width}")
    assert 0 < ann.met(first, probes).select("q", "c").distinct().count() < len(want)
    assert ann.met(index.limit(0), probes).count() == 0


def test_probes_are_the_near_values_and_those_of_least_margin():
    x = clusters(600)
    coder = ann.learn(x, 1.0, len(x))
    coder.probes = coder.width + 1 + 5
    asked = ann.projected_queries(x[:50], coder)
    own, looked = ann.values(asked, coder), ann.probe_values(asked, coder)
    assert looked.shape == (50, coder.substrings, coder.probes)
    near = np.bitwise_count(looked ^ own[:, :, None])
    assert (np.sort(near[:, :, : coder.width + 1], axis=2) == [0] + [1] * coder.width).all() and (near[:, :, coder.width + 1 :] > 1).all()
    for q in range(50):
        margins = asked[q, : coder.width] ** 2
        cost = [sum(margins[b] for b in range(coder.width) if v >> b & 1) for v in range(1 << coder.width)]
        several = sorted((c, v) for v, c in enumerate(cost) if bin(v).count("1") > 1)
        assert [int(v) for v in looked[q, 0, coder.width + 1 :] ^ own[q, 0]] == [v for _, v in several[:5]]


def test_tables_between_steps_can_be_cleared(spark, docs):
    from fiatscan.llm import common

    kept = common.stored(docs.select("doc_id"), "kept")
    assert kept.count() == docs.count() and common._PATHS
    common.clear(spark)
    assert not common._PATHS
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(kept.inputFiles()[0] if kept.inputFiles() else "/nowhere").count()


def test_category_cells_over_many_values(spark):
    """The order found range by range is the order of all values."""
    from collections import Counter

    from fiatscan.llm import sharding

    rng = random.Random(3)
    values = [None] * 5 + [""] * 3 + [f"http://host{rng.randint(0, 900)}.example" for _ in range(3000)] + ["hot"] * 1500
    rows = spark.createDataFrame([(v,) for v in values], "source string").repartition(7)
    got = {r.source: r.cell for r in sharding.with_category_cell(rows, "source", "cell").select("source", "cell").distinct().collect()}
    counts, before, want = Counter(values), 0, {}
    for v in sorted(counts, key=lambda v: (v is not None, v or "")):
        want[v] = before * 16 // len(values)
        before += counts[v]
    assert got == want and len(set(got.values())) > 5
