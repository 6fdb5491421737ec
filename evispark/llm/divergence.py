"""How far the sources of a language lie apart in their words, over all documents.

Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII. A language keeps the terms that at least ``least`` of
its documents hold. With count n of a kept term in a group, N the sum of such counts and V kept terms, the group's
part of the term is ``p = 1 + floor(SHARE * (n + 1) / (N + V))``, and two groups differ in it by
``floor((p - q)^2 / q)``. Groups are the sources of a language, and the language as a whole.

Terms are counted in each task first, in dictionaries of bounded size. A kept term's counts are then pivoted into one
wide vector, an array with a slot for each source of the language, of which only the slots that aren't zero are stored.
Higher-order functions emit for each vector the contribution of every pair of its sources, which are summed in each
task before they are exchanged. A zero slot has the same p for all terms of a source, so what pairs with one zero slot
or two contribute is added in closed form: from how many terms have which count in a source, and from V. The sums are
those of full vectors, and the work is that of the occurring (term, source) pairs.

Defined results: null texts, languages and sources count as ''; every group that occurs has its rows, also without terms
(values are 0 if nothing is kept); a language with one source has no pairs; repeated rows count as often as they occur;
an empty table gives an empty table; other columns play no part. Sums fit 64 bits up to a billion kept terms a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.columns import at, by_place
from evispark.llm.simhash import join_keyed
from evispark.session import cut_lineage

LEAST, TOP, SHARE = 3, 200, 1_000_000_000
#: Terms that a task holds before it passes their counts on, and bytes of a text that are split at once.
HELD, CHUNK = 500_000, 1 << 20
#: Groups whose numbers are broadcast (some 60 bytes each); more are joined by exchange, but for the hot ones.
FEW = 100_000
#: Shares of a group's terms that are ranked apart first.
SHARES = 32
#: Bytes of terms stay, those of A-Z as a-z; all others part terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The terms of a text, from slices that end between terms."""
    text, start = text.translate(BYTES), 0
    while start < len(text):
        end = len(text) if start + chunk >= len(text) else text.rfind(b" ", start, start + chunk)
        if end < 0:
            end = text.find(b" ", start + chunk)
            end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end + 1


def counted(held: int = HELD):
    """Over rows (lang, source, text): (lang, source, term, n, docs), summed over what a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: defaultdict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = [pa.array([v], pa.string()).take(pa.array([0] * len(n), pa.int32())) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for key, text in zip(keys, batch.column("text").cast(pa.large_binary())):
                n, docs = groups[key]
                seen: set[bytes] = set()
                for terms in pieces(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                if len(seen) > 1000 and sum(len(g[0]) for g in groups.values()) > held:
                    yield from emptied()
            if sum(len(g[0]) for g in groups.values()) > held:
                yield from emptied()
        yield from emptied()

    return run


def share(n: str, total: str) -> str:
    """p of a count; exact beyond 64 bits."""
    return f"(1 + (CAST({SHARE} AS DECIMAL(12, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) div CAST({total} AS DECIMAL(20, 0)))"


def apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def numbered_groups(rows: DataFrame) -> DataFrame:
    """(lang, source, slot, n): the groups of rows, numbered within their language in order of their names, and their rows."""
    held = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return cut_lineage(held.withColumn("slot", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))


def with_slot(counts: DataFrame, groups: DataFrame) -> DataFrame:
    if groups.count() <= FEW:
        return counts.join(F.broadcast(groups.select("lang", "source", "slot")), ["lang", "source"])
    key = F.struct("lang", "source")
    lookup = groups.select(key.alias("group_"), "slot", "n")
    return join_keyed(counts.withColumn("group_", key).withColumnRenamed("n", "n_"), lookup, "group_", groups.agg(F.sum("n")).first()[0]).drop("group_").withColumnRenamed("n_", "n")


def wide_vectors(rows: DataFrame, groups: DataFrame, least: int, held: int) -> DataFrame:
    """(lang, term, total, slots): the kept terms, their counts in all, and the slots (slot, n) that aren't zero."""
    counts = rows.mapInArrow(counted(held), "lang string, source string, term string, n bigint, docs bigint")
    counts = with_slot(counts, groups).groupBy("lang", "term", "slot").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("slots"))
    return cut_lineage(wide.where(F.col("docs") >= least).select("lang", "term", "total", "slots"))


def languages(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, n, total, sources, sums, zeros): V, the sum of all counts, and by slot the sources, N, and p of a zero slot."""
    sums = terms.select("lang", F.explode("slots").alias("s")).groupBy("lang", F.col("s.slot").alias("slot")).agg(F.sum("s.n").alias("sum"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("n"))
    each = groups.drop("n").join(sums, ["lang", "slot"], "left").join(kept, "lang", "left")
    each = each.select("lang", F.coalesce("n", F.lit(0)).alias("n"), F.struct("slot", "source", F.coalesce("sum", F.lit(0)).alias("sum")).alias("g"))
    held = each.groupBy("lang", "n").agg(F.sort_array(F.collect_list("g")).alias("g"), F.sum("g.sum").alias("lang_sum"))
    zeros = F.expr(f"transform(g, x -> IF(n = 0, 1, {share('0', 'x.sum + n')}))")
    return cut_lineage(held.select("lang", "n", "lang_sum", F.col("g.source").alias("sources"), F.col("g.sum").alias("sums"), zeros.alias("zeros")))


def both_ways(i: str, j: str, forth: str, back: str) -> str:
    return f"explode(array(named_struct('slot', {i}, 'other', {j}, 'value', {forth}), named_struct('slot', {j}, 'other', {i}, 'value', {back}))) AS c"


def contributions(vectors: DataFrame) -> DataFrame:
    """(lang, slot, other, value): what the terms that two sources share add to the difference of each to the other, over
    what those terms would with a zero in one slot or in both."""
    pairs = "transform(slots, (a, k) -> transform(slice(slots, k + 2, size(slots)), b -> named_struct('a', a, 'b', b)))"
    held = vectors.select("lang", F.explode(F.flatten(F.expr(pairs))).alias("x")).select("lang", *[F.col(f"x.{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("slot", "p", "z")])
    over = lambda s, t: f"{apart(f'p_{s}', f'p_{t}')} - {apart(f'p_{s}', f'z_{t}')} - {apart(f'z_{s}', f'p_{t}')} + {apart(f'z_{s}', f'z_{t}')}"
    summed = held.groupBy("lang", "slot_a", "slot_b").agg(F.sum(F.expr(over("a", "b"))).alias("forth"), F.sum(F.expr(over("b", "a"))).alias("back"))
    return summed.selectExpr("lang", both_ways("slot_a", "slot_b", "forth", "back")).select("lang", "c.*")


def against_zeros(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """As contributions: what the terms of one source add with a zero in the other's slot, by how many have which count."""
    held = vectors.select("lang", F.explode("slots").alias("s")).select("lang", "s.*").groupBy("lang", "slot", "n", "p", "z").agg(F.count("*").alias("terms"))
    held = cut_lineage(held.withColumnRenamed("n", "count"))
    sizes = held.groupBy("lang").agg(F.count("*").alias("n"))
    lookup = langs.select("lang", "zeros").join(sizes, "lang")
    rows = join_keyed(held, lookup, "lang", held.count()).select("lang", "slot", "terms", "p", "z", F.posexplode("zeros").alias("other", "y")).where("slot <> other")
    forth, back = f"terms * ({apart('p', 'y')} - {apart('z', 'y')})", f"terms * ({apart('y', 'p')} - {apart('y', 'z')})"
    return rows.selectExpr("lang", both_ways("slot", "other", forth, back)).select("lang", "c.*")


def pair_rows(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): every other source of a source's language and the difference to it."""
    slots = langs.select("lang", "n", F.expr("transform(sources, (s, k) -> named_struct('slot', k, 'source', s, 'z', zeros[k]))").alias("g"))
    pairs = slots.select("lang", "n", "g", F.explode("g").alias("a")).select("lang", "n", "a", F.explode("g").alias("b")).where("a.slot <> b.slot")
    every = pairs.selectExpr("lang", "a.slot AS slot", "b.slot AS other", f"n * {apart('a.z', 'b.z')} AS value", "a.source AS source", "b.source AS item")
    nameless = [F.lit(None).cast("string").alias(c) for c in ("source", "item")]
    rows = every.unionByName(contributions(vectors).select("*", *nameless)).unionByName(against_zeros(vectors, langs).select("*", *nameless))
    return rows.groupBy("lang", "slot", "other").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("value").alias("value")).select("lang", "source", "item", "value")


def term_rows(vectors: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more of than its language, the first by difference."""
    more = vectors.select("lang", "term", "q", F.explode(F.expr("filter(slots, s -> s.p > q)")).alias("s"))
    rows = more.selectExpr("lang", "s.slot AS slot", "term AS item", f"{apart('s.p', 'q')} AS value")
    ranked = lambda held, *keys: held.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    first = ranked(rows.withColumn("share", F.pmod(F.xxhash64("item"), F.lit(SHARES))), "lang", "slot", "share")
    best = ranked(first.select("lang", "slot", "item", "value"), "lang", "slot")
    return best.join(groups.select("lang", "slot", "source"), ["lang", "slot"]).select("lang", "source", "item", "value", "rank")


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, held: int = HELD) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part ``pair``: the difference of a source to each other one of its
    language, over all kept terms. Part ``term``: the ``top`` terms that a source has more of than its language."""
    named = by_place(docs).select(*[F.coalesce(at(docs, c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    groups = numbered_groups(named.select("lang", "source"))
    terms = wide_vectors(named, groups, least, held)
    langs = languages(terms, groups)
    slots = f"transform(slots, s -> named_struct('slot', s.slot, 'n', s.n, 'p', {share('s.n', 'sums[s.slot] + n')}, 'z', zeros[s.slot]))"
    vectors = join_keyed(terms, langs.select("lang", "n", "lang_sum", "sums", "zeros"), "lang", terms.count(), keep=("n",))
    vectors = vectors.select("lang", "term", F.expr(share("total", "lang_sum + n")).alias("q"), F.expr(slots).alias("slots"))
    pairs = pair_rows(vectors, langs).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(term_rows(vectors, groups, top), "term"))
