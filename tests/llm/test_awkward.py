"""Cases that once went wrong: documents of several texts, skewed bytes, odd pages, indices of one substring."""

import os
import random
import re
import time

import numpy as np
import pytest

from fiatscan.llm import ann, html_text, near_dedup, token_records

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows, threshold):
    """Documents of several rows hold the links of all of them."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def near_copies(rng, n):
    """n texts, each near the one before."""
    words = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    out = []
    for _ in range(n):
        out.append(" ".join(words))
        words = list(words)
        words[rng.randrange(120)] = f"x{rng.randint(0, 9999)}"
    return out


@pytest.mark.parametrize("partitions", [1, 4])
def test_documents_of_several_texts_keep_all_links(spark, partitions):
    rng = random.Random(partitions)
    a, b, c = (near_copies(rng, 4) for _ in range(3))
    rows = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (4, c[0]), (5, c[1]), (5, "a text of its own with some words in it"), (5, c[1]), (9, c[2]), (9, a[2]), (10, "lone"), (None, a[3])]
    rows += [(20 + k % 3, t) for k, t in enumerate(near_copies(rng, 9))] + [(7, None), (7, ""), (1, "short"), (6, "short"), (6, b[3])]
    want = plain_components(rows, 85)
    assert want[2] == want[3] == want[6] == 1
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    for blocks in ({}, {"block": 2, "block_limit": 2, "star_block": 2}):
        got = near_dedup.near_duplicates(table, **blocks).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)
        assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == sorted((i or 0, len(shingles(t))) for i, t in rows)


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_record_files_are_bounded_by_bytes(spark, tmp_path, tokenizer):
    """4000 short texts, then 40 long ones that all fall into one range: no file passes the bound, but for a single longer record."""
    rng = random.Random(2)
    rows = [(i, "short text") for i in range(4000)] + [(4000 + i, " ".join(f"{rng.randint(0, 99999)}" for _ in range(9000 if i != 7 else 60000))) for i in range(40)]
    path, bound = f"file://{tmp_path}/records", 64 << 10
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(token_records.encode_documents(table, tokenizer, path, file_bytes=bound).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(4040))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    held = {}
    for r in got:
        held.setdefault(r.path, []).append(r.doc_id)
    for f, ids in held.items():
        assert os.path.getsize(f.removeprefix("file:").replace("///", "/")) <= bound or len(ids) == 1
    assert [4007] in held.values() and max(len(v) for v in held.values()) > 100


ARTICLE = "<h1>A title</h1><p>The first sentence of an article with words enough.</p><p>The second one, which has some more words than the first.</p>"
TEXT = "A title\nThe first sentence of an article with words enough.\nThe second one, which has some more words than the first."


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body><form action=x><input type=hidden name=state>{ARTICLE}</form></body>", TEXT),
        (f"<body><form action=x><div>{ARTICLE}</div></form><div>Made by us</div></body>", TEXT),
        (f"<body><dialog open><div class=content>{ARTICLE}</div></dialog></body>", TEXT),
        (f"<body><article>{ARTICLE}<form><label>Your mail</label><input name=m><button>Send</button></form></article></body>", TEXT),
        (f"<body><div id=app></div><noscript><article>{ARTICLE}</article></noscript></body>", TEXT),
        (f"<body><article>{ARTICLE}<aside><p>A note on it.</p></aside><menu><li>Step one</li></menu></article><aside><p>Most read</p></aside></body>", TEXT + "\nA note on it.\nStep one"),
        ("<body><article><p>Press <button>OK</button> and wait for the answer.</p></article></body>", "Press and wait for the answer."),
        ("<body><form><p>Name</p><input></form><div><p>What the page has to say, at some length, stands here.</p></div></body>", "What the page has to say, at some length, stands here."),
    ],
)
def test_what_holds_the_article_is_kept(page, text):
    assert html_text.extract(page, []) == text


@pytest.mark.parametrize("page,ends", [('<div class="post-row">' * 100_000, ""), ("<div>word " * 100_000, "word"), ("<div>x" * 50_000 + "</div>y" * 50_000, "y"), ("<div>" * 50_000 + "one text" + "</p>" * 100_000, "one text"), ("<form>" * 100_000 + "x", "x")])
def test_deep_pages_take_seconds(page, ends):
    began = time.process_time()
    assert html_text.extract(page, []).endswith(ends)
    votes = html_text.votes(page)
    assert time.process_time() - began < 15 and all(len(p) < 1000 for p in votes)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_the_given_tables_get_several_indices(table):
    """Several substrings on the registered tables, and by their probes alone at least nine of ten neighbours."""
    path = f"/root/testdata/{table}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    x = np.array(pq.read_table(path, columns=["embedding"])["embedding"].to_pylist(), float)
    coder = ann.learn(x[:4096], float(np.sqrt((x * x).sum(1)).max()), len(x))
    assert coder.substrings >= ann.LEAST_SUBSTRINGS
    asked, held = ann.projected_queries(x[::20], coder), ann.projected(x, coder)
    looked, own = ann.probe_values(asked, coder), ann.values(held, coder)
    met = np.array([[np.isin(own[:, k], looked[q, k]) for k in range(coder.substrings)] for q in range(len(asked))])
    assert all(met[:, k].mean() < 0.6 for k in range(coder.substrings))
    scores = x[::20] @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked)) * 20] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.take_along_axis(met.any(axis=1), best, axis=1).mean() > 0.9
