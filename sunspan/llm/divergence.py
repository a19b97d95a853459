"""Source divergence audit: how far the word use of each source is from that of its language and of its other sources.

DuckDB does the counting inside Spark's tasks: each task counts terms of its own documents, hash shards by language and
term add these counts up and keep the terms that enough documents have, and in a second pass each shard gives partial
sums for pairs of sources and its best terms. Spark deals the shards and merges sums and rankings.

A pair's value is the sum of |p - q| over all kept terms. Shards only see terms that a source has, so the sum is put
together from three parts that are exact in whole numbers: what it would be if neither source had any term (z is the p
of a term without occurrences), what each source's own terms change in that, and a correction for terms of both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunspan.llm._arrow import release, slices, stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GAP = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, SMOOTH = 1_000_000_000, 5
LEAST_DOCS, TOP_TERMS = 30, 50
#: Characters of a text that DuckDB splits at once; longer texts go in pieces.
PIECE = 1 << 20
#: Rows of a shard that are worked on at once, and sources whose pairs are.
SHARD_ROWS, SOURCE_BLOCK = 400_000, 1024
#: Into how many parts the sources of a language are dealt where they meet each other.
SALT = 16

COUNT = f"""
    SELECT lang, source, term, sum(n)::BIGINT AS n, count(DISTINCT doc) AS docs
    FROM (SELECT doc, lang, source, term, count(*) AS n
          FROM (SELECT doc, lang, source, unnest(regexp_extract_all(translate(piece, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM pieces)
          GROUP BY ALL)
    GROUP BY lang, source, term"""
MERGE = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY lang, source, term"
KEEP = """
    SELECT lang, term, source, sum(n)::BIGINT AS n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first
    FROM counts GROUP BY lang, term, source
    QUALIFY sum(sum(docs)) OVER (PARTITION BY lang, term) >= {least}"""
SHARES = f"""
    CREATE OR REPLACE TEMP TABLE shares AS
    SELECT lang, term, source, dense_rank() OVER (PARTITION BY lang ORDER BY source) // {SOURCE_BLOCK} AS block,
           (1 + {SCALE}::HUGEINT * (n + {SMOOTH}) // (total + {SMOOTH} * vocabulary))::BIGINT AS p,
           (1 + {SCALE}::HUGEINT * {SMOOTH} // (total + {SMOOTH} * vocabulary))::BIGINT AS z,
           (1 + {SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {SMOOTH}) // (lang_total + {SMOOTH} * vocabulary))::BIGINT AS q
    FROM counts"""
MEET = """
    SELECT 'meet' AS kind, a.lang, a.source, b.source AS item, 0::BIGINT AS p,
           sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z))::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source
    WHERE a.block = $one AND b.block = $two GROUP BY a.lang, a.source, b.source"""
OWN = "SELECT 'own' AS kind, lang, source, NULL::VARCHAR AS item, p, count(*)::BIGINT AS value FROM shares GROUP BY lang, source, p"
BEST = """
    SELECT 'best' AS kind, lang, source, term AS item, 0::BIGINT AS p, p - q AS value FROM shares WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}"""

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("first", pa.bool_())])
SUMS = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("p", pa.int64()), ("value", pa.int64())])


def _database() -> duckdb.DuckDBPyConnection:
    """A database in a task's memory, with one thread; nothing is written to the machine's disk."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "preserve_insertion_order": False})


def _rows(found: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from found.select(schema.names).cast(schema).to_batches(max_chunksize=50_000)


def _pieces(batch: pa.RecordBatch, before: int) -> Iterator[pa.Table]:
    """Rows (doc, lang, source, piece), some PIECE characters at once; long texts are cut where no term is."""
    out: dict[str, list] = {"doc": [], "lang": [], "source": [], "piece": []}
    size = 0
    for i, (lang, source, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True)):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                gap = GAP.search(text, at + PIECE)
                end = gap.end() if gap else end
            for name, value in (("doc", before + i), ("lang", lang), ("source", source), ("piece", text[at:end])):
                out[name].append(value)
            size, at = size + end - at, end
    if out["doc"]:
        yield pa.table({"doc": pa.array(out["doc"], pa.int64()), **{c: pa.array(out[c], pa.string()) for c in ("lang", "source", "piece")}})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents by language, source and term; merged while they are many."""
    db, held, size, before = _database(), [], 0, 0
    for batch in slices(batches):
        for pieces in _pieces(batch, before):
            db.register("pieces", pieces)
            held.append(db.sql(COUNT).to_arrow_table().cast(COUNTS))
            size += held[-1].num_rows
        before += batch.num_rows
        if size > 2 * SHARD_ROWS:
            db.register("counts", pa.concat_tables(held))
            held = [db.sql(MERGE).to_arrow_table().cast(COUNTS)]
            size = held[0].num_rows
            if size > SHARD_ROWS:
                yield from _rows(held[0], COUNTS)
                held, size = [], 0
    if held:
        db.register("counts", pa.concat_tables(held))
        yield from _rows(db.sql(MERGE).to_arrow_table(), COUNTS)
    db.close()
    release()


def _whole_terms(db: duckdb.DuckDBPyConnection, batches: Iterator[pa.RecordBatch], merge: bool) -> Iterator[pa.Table]:
    """A sorted shard in tables of whole terms; counts of a term that is spread over more rows are merged on the way."""
    held: list[pa.RecordBatch] = []
    fresh = 0  # rows since the last look
    for batch in batches:
        held.append(batch)
        fresh += batch.num_rows
        if fresh < SHARD_ROWS:
            continue
        table = pa.Table.from_batches(held)
        lang, term = table["lang"][-1].as_py(), table["term"][-1].as_py()
        db.register("held", table)
        [(last,)] = db.execute("SELECT count(*) FROM held WHERE lang = ? AND term = ?", [lang, term]).fetchall()
        if last < table.num_rows:
            yield table.slice(0, table.num_rows - last)
        rest = table.slice(table.num_rows - last)
        if merge and rest.num_rows:
            db.register("counts", rest)
            rest = db.sql(MERGE).to_arrow_table().cast(COUNTS).select(table.column_names).cast(table.schema)
        held, fresh = rest.to_batches(), 0 if rest.num_rows >= SHARD_ROWS else rest.num_rows
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, n and first (true in one row of each term) of terms that enough documents of a language have.

    ``docs`` has lang, source and text without nulls. One shuffle, by language and term, of counts that each task has
    added up before; a term that every task has is as many rows as tasks and sources, and is read in pieces.
    """
    keep = KEEP.format(least=int(least_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database()
        for table in _whole_terms(db, batches, merge=True):
            db.register("counts", table)
            yield from _rows(db.sql(keep).to_arrow_table(), KEPT)
        db.close()
        release()

    counts = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    shards = counts.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return shards.mapInArrow(run, "lang string, term string, source string, n long, first boolean")


def shard_sums(weighed: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """kind, lang, source, item, p, value: partial sums of pairs (meet), terms by share (own) and best terms of shards (best)."""
    best = BEST.format(top=int(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database()
        for table in _whole_terms(db, batches, merge=False):
            db.register("counts", table)
            db.execute(SHARES).fetchall()
            [(blocks,)] = db.execute("SELECT max(block) FROM shares").fetchall()
            for one in range(blocks + 1):
                for two in range(one, blocks + 1):
                    yield from _rows(db.sql(MEET, params={"one": one, "two": two}).to_arrow_table(), SUMS)
            yield from _rows(db.sql(OWN).to_arrow_table(), SUMS)
            yield from _rows(db.sql(best).to_arrow_table(), SUMS)
        db.close()
        release()

    shards = weighed.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return shards.mapInArrow(run, "kind string, lang string, source string, item string, p long, value long")


def divergence(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: how far sources are from each other and by which terms they stand out.

    Part pair has every other source of the language, by the sum of |p - q| over the language's kept terms; part term
    the ``top`` terms that the source has and uses more than its language, by p - q. Shares are smoothed whole
    billionths. Null text, lang and source are empty strings, which are values of their own; a row is a document, so
    repeated rows count again; whole texts count, whatever their length; ties go to the item of lesser UTF-8. A group
    without terms has rows of part pair; a language without kept terms has pairs of value 0; a single source has no
    pair; an empty table gives no rows; other columns are not looked at.

    Nothing is broadcast but what Spark finds small. The result has a row for each pair of sources of a language, so
    pairs are met by equality of language and a salt.
    """
    docs = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = stored(kept_counts(docs, least_docs), "divergence-counts")
    groups = docs.select("lang", "source").distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    whole = Window.partitionBy("lang")  # a row for each source
    sizes = groups.join(sizes, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.sum("total").over(whole), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("firsts").over(whole), F.lit(0)).alias("vocabulary")
    )
    sizes = stored(sizes, "divergence-groups")
    sums = shard_sums(kept.join(sizes, ["lang", "source"]), top)
    sums = stored(sums.groupBy("kind", "lang", "source", "item", "p").agg(F.sum("value").alias("value")), "divergence-sums")

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    best = sums.where("kind = 'best'").select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank")).where(F.col("rank") <= top)

    none = F.expr(f"if(vocabulary = 0, 0L, 1L + {SCALE * SMOOTH}L div (total + {SMOOTH}L * vocabulary))")
    ends = sizes.select("lang", "source", "vocabulary", none.alias("z"))
    one = ends.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALT)))
    two = ends.select("lang", F.col("source").alias("item"), F.col("z").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    pairs = one.join(two, ["lang", "salt"]).where("source <> item")
    pairs = pairs.select("lang", "source", "item", "at", F.lit(0).cast("long").alias("terms"), F.abs(F.col("z") - F.col("at")).alias("apart"), "vocabulary")
    own = sums.where("kind = 'own'").select("lang", "source", F.lit(None).cast("string").alias("item"), F.col("p").alias("at"), F.col("value").alias("terms"), F.lit(0).cast("long").alias("apart"), F.lit(0).cast("long").alias("vocabulary"))
    below = Window.partitionBy("lang", "source").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("lang", "source")
    n, share = F.col("terms"), F.col("terms") * F.col("at")
    changed = F.col("at") * (2 * F.sum(n).over(below) - F.sum(n).over(every)) + F.sum(share).over(every) - 2 * F.sum(share).over(below) - F.sum(n).over(every) * F.col("apart")
    moved = pairs.unionByName(own).withColumn("changed", changed).where("item IS NOT NULL")
    turned = lambda d, value: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), value)
    met = sums.where("kind = 'meet'").select("lang", "source", "item", "value")
    parts = moved.select("lang", "source", "item", (F.col("vocabulary") * F.col("apart") + F.col("changed")).alias("value"))
    parts = parts.unionByName(turned(moved, F.col("changed").alias("value"))).unionByName(met).unionByName(turned(met, F.col("value")))
    apart = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank")).unionByName(best)
