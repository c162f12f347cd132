"""Audit of how far sources of a language differ in their terms, by wide term vectors.

Tasks count the terms of their documents by (lang, source) and hand on partial counts, which Spark sums. Each term kept for a language
(in at least `min_docs` of its documents) becomes one row with an array of shares, one place for each source of the language. From such
a row, higher-order functions of the JVM make the contribution of the term to each pair of sources; these are summed
before the shuffle, so that what is shuffled are pairs, not terms. A row gives the pairs of one source at a time, so memory follows
the number of sources, not its square.

share(count, N) = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), V the kept terms of the language, N the counts of the group's kept terms;
difference of two shares p, q: floor((p - q)**2 / (p + q)). All of it is whole-number arithmetic, decimals where a product can pass 64 bits.

Null lang and source are the group ''; null and empty texts count as documents without terms, so a group without any term still is compared
(with the shares of zero counts), and a language that keeps no term has pairs of value 0. A language with one source has no pairs. Repeated rows
are documents of their own. An empty table gives no rows. Very long texts are counted whole, in bounded runs. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .hashing import chunks
from .terms import fold_table, text_runs

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
PART_BYTES = 4 << 20  # of text counted at once
LETTERS = fold_table(digits=False)


def counted(texts: list[bytes], groups: np.ndarray) -> pa.Table:
    """Folded texts and the group of each -> group, term, n (occurrences), docs (texts with it)."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    flat = words.flatten().dictionary_encode()
    n_terms = max(1, len(flat.dictionary))
    code = flat.indices.to_numpy().astype(np.int64)
    text = pc.list_parent_indices(words).to_numpy()
    real = code != pc.index(flat.dictionary, pa.scalar("", pa.large_string())).as_py()  # blanks at a text's ends give empty words
    code, text = code[real], text[real]
    held, _ = np.unique(text * n_terms + code, return_counts=True)  # with counts, numpy sorts, which is faster than its hashing here
    all_keys, n = np.unique(groups[text] * n_terms + code, return_counts=True)
    keys, docs = np.unique(groups[held // n_terms] * n_terms + held % n_terms, return_counts=True)
    return pa.table({"group": all_keys // n_terms, "term": flat.dictionary.take(pa.array(keys % n_terms)), "n": n, "docs": docs})


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, term, n, docs, summed over a batch's texts. A long text is counted in parts."""
    for batch in batches:
        names = [pa.array(batch.column(k)).dictionary_encode() for k in range(2)]
        codes = [c.indices.to_numpy().astype(np.int64) for c in names]
        groups = codes[0] * len(names[1].dictionary) + codes[1]
        texts = [t.translate(LETTERS) for t in batch.column(2).to_pylist()]
        for part in chunks([len(t) for t in texts], PART_BYTES):
            if part.stop - part.start == 1 and len(texts[part.start]) > PART_BYTES:
                several = pa.concat_tables([counted([run], groups[part]) for run in text_runs(texts[part.start], PART_BYTES)])
                found = several.group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "max")]).rename_columns(["group", "term", "n", "docs"])
            else:
                found = counted(texts[part], groups[part])
            group = found["group"].to_numpy()
            lang, source = (c.dictionary.take(pa.array(k)) for c, k in zip(names, (group // len(names[1].dictionary), group % len(names[1].dictionary))))
            columns = [lang, source, found["term"].cast(pa.string()).combine_chunks(), found["n"].combine_chunks(), found["docs"].combine_chunks()]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """documents -> lang, source, term, n, docs."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(*_group(), text.alias("text"))
    partial = rows.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def share(count: str, total: str) -> str:
    """SQL of a share; `v` is the number of kept terms."""
    return f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * v as decimal(20,0))"


def difference(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def wide_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, sources, totals, v, total), a row a language, and (lang, term, q, p, counts), a row a kept term: shares in the language and,
    in the order of `sources`, in each source."""
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("held"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stored(by_term.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    in_source = kept.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(*_group()).distinct().join(in_source, ["lang", "source"], "left")
    ordered = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    layout = ordered.join(sizes, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    layout = stored(layout, "source-layout")
    placed = kept.join(layout, "lang").withColumn("counts", F.expr("transform(sources, s -> coalesce(try_element_at(held, s), 0))"))
    p = F.expr(f"transform(counts, (c, i) -> {share('c', 'totals[i]')})")
    return layout, placed.select("lang", "term", F.expr(share("n", "total")).alias("q"), p.alias("p"), "counts", "sources")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """documents -> lang, source, part, item, value, rank.

    part 'pair': item is another source of the language, value the summed differences of all kept terms. part 'term': item is one of the
    `top` terms that the source uses most beyond the language. Ranks are by falling value, then item.
    """
    small_batches(docs.sparkSession, 4000)
    layout, wide = wide_vectors(docs, min_docs)
    wide = stored(wide, "wide-terms")
    each = wide.select("lang", "p", F.posexplode("p").alias("a", "pa"))
    parts = each.select("lang", "a", F.posexplode(F.expr(f"transform(slice(p, a + 2, size(p) - a - 1), x -> {difference('pa', 'x')})")).alias("beyond", "f"))
    sums = parts.groupBy("lang", "a", (F.col("a") + F.col("beyond") + 1).alias("b")).agg(F.sum("f").alias("f"))
    every = layout.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    named = every.withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")}).join(sums, ["lang", "a", "b"], "left")
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).cast("long").alias("value"))
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(rank))
    above = wide.select("lang", "term", "q", F.explode(F.expr("filter(arrays_zip(sources, p, counts), g -> g.counts > 0 and g.p > q)")).alias("g"))
    terms = above.select("lang", F.col("g.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(difference("g.p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)  # Spark limits each task to `top` rows a group before the shuffle
    return pairs.unionByName(terms)


def oracle_sql(min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    """The query's result in DuckDB SQL."""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), {lower}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
t as (select rid, lang, source, term, count(*) as n from (select rid, lang, source, unnest(w) as term from d) x group by rid, lang, source, term),
kept as (select lang, term, sum(n) as n from t group by lang, term having count(*) >= {min_docs}),
g as (select distinct lang, source from d),
c as (select lang, source, term, sum(n) as n from t join (select lang, term from kept) k using (lang, term) group by lang, source, term),
grid as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n from g join kept on kept.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
gt as (select lang, source, sum(n) as total from grid group by lang, source),
lt as (select lang, sum(n) as total, count(*) as v from kept group by lang),
gp as (select lang, source, term, grid.n, 1 + (1000000000 * (cast(grid.n as hugeint) + 2)) // (gt.total + 2 * lt.v) as p from grid join gt using (lang, source) join lt using (lang)),
lp as (select lang, term, 1 + (1000000000 * (cast(kept.n as hugeint) + 2)) // (lt.total + 2 * lt.v) as q from kept join lt using (lang)),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(f.value, 0) as value from g x join g y on x.lang = y.lang and x.source <> y.source left join f on f.lang = x.lang and f.source = x.source and f.item = y.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from gp join lp using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from (select * from pairs union all select * from terms) u)
select lang, source, part, item, cast(value as bigint) as value, cast(r as integer) as rank from ranked where part = 'pair' or r <= {top}"""
