"""Benchmark decontamination by a distributed positional inverted index.

DataFrame and SQL functions only. One pass over the corpus stores the postings of every
training token that is also a test term: for each document (the index is divided by documents,
so each executor intersects what it stores, and no list is moved) its postings, a list of
positions for each term. Test terms are told from other words by a Bloom filter of the test
set; what it lets through besides is never looked up. Counts over the whole corpus order the terms of
each test window from the rarest on. A window is looked up in the documents that have its
rarest term: that term's list, moved by its place in the window, is intersected with the moved
lists of the others, from the next rarest on, until it is empty or the terms are used up. What
is left are the starts of exact phrase matches. Proximity matches want all terms of a window within
a span, in any order, around an occurrence of the rarest.

The windows are broadcast up to ``BROADCAST_WINDOWS`` of them, beyond that joined by a shuffle
of (document, term) pairs. Documents are told apart by a number that is written with the
index, so null and repeated ids don't matter.

Defined cases: null, empty and wordless texts have no words and no hits; very long texts are one
index row each; a test item without words has no window; equal item ids are one item; equal
windows of several items count for each; each of several equal rows gets its own row; an
empty benchmark leaves all clean; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stash, table

WINDOW = 10
BROADCAST_WINDOWS = 200_000
#: Bits of the Bloom filter: 32 a term at least, a power of two, and not over so many.
MAX_BLOOM_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of lower-cased text: all but x00-x2F, x3A-x60, x7B-x7F. Named by what is in it, as a
#: negated class is many times slower to match.
_WORD = r"[a-z0-9\x80-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes the words. lower() is much faster than translate() and
    the same where all is ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(_WORD), F.lit(0))


def windows_of(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, terms: distinct windows of ``window`` words; a shorter item is one."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return w.select("item_id", F.explode(starts).alias("s"), "w").select("item_id", F.expr(f"slice(w, s, {window})").alias("terms")).distinct()


def bloom_filter(terms: DataFrame) -> tuple[DataFrame, int]:
    """One row with the filter's longs, and its number of bits. terms: term, distinct."""
    bits = 4096
    while bits < min(32 * terms.count(), MAX_BLOOM_BITS):
        bits *= 2
    at = terms.select(F.xxhash64("term").bitwiseAND(F.lit(bits - 1)).alias("i"))
    longs = at.groupBy(F.shiftright("i", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("v"))
    every = terms.sparkSession.range(bits // 64).join(longs, F.col("id") == F.col("k"), "left").select("id", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("longs")), bits


def index_of(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number), id, n_words, postings map<term, positions>: of each document the ascending
    positions (from 0) of each of its words that is among ``terms``, and of few others."""
    bloom, bits = bloom_filter(terms)

    def among(x: Column) -> Column:
        i = F.xxhash64(x).bitwiseAND(F.lit(bits - 1))
        return F.getbit(F.get(F.col("longs"), F.shiftright(i, 6).cast("int")), i.bitwiseAND(F.lit(63)).cast("int")) == 1

    w = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    # one reference to the filter, so that it is inlined as a scalar and no row carries it
    kept = w.select("row", "id", "w", bloom.scalar().alias("longs"))
    placed = F.transform("w", lambda x, i: F.struct(x.alias("term"), i.alias("pos")))
    kept = kept.select("row", "id", F.size("w").cast("long").alias("n_words"), F.sort_array(F.filter(placed, lambda p: among(p["term"]))).alias("p"))
    # by lambdas: the optimizer would take p.term to be free, and build it anew for each element
    flat = kept.select("row", "id", "n_words", F.transform("p", lambda x: x["term"]).alias("t"), F.transform("p", lambda x: x["pos"]).alias("at"))
    # sorted by term, so a term's positions end where the next term's begin
    new = F.transform("t", lambda x, i: F.when((i == 0) | (F.get("t", i - 1) != x), i))
    begin = flat.withColumn("b", F.filter(new, lambda i: i.isNotNull())).withColumn("e", F.concat(F.slice("b", 2, F.size("t")), F.array(F.size("t"))))
    terms = F.transform("b", lambda i: F.get("t", i))
    lists = F.zip_with("b", "e", lambda i, j: F.slice("at", i + 1, j - i))
    return begin.select("row", "id", "n_words", F.when(F.size("t") == 0, F.create_map().cast("map<string,array<int>>")).otherwise(F.map_from_arrays(terms, lists)).alias("postings"))


def ranked(windows: DataFrame, index: DataFrame) -> DataFrame:
    """term, items, parts: for each distinct window its rarest term, its items, and its terms as
    struct<term, off> from the rarest on. Windows with a term that the corpus lacks can't
    occur and are left out."""
    counts = index.select(F.explode("postings").alias("term", "at")).groupBy("term").agg(F.sum(F.size("at")).alias("n"))
    wins = windows.groupBy("terms").agg(F.collect_set("item_id").alias("items"))
    flat = wins.select("terms", "items", F.posexplode("terms").alias("off", "term")).join(counts, "term", "left")
    parts = F.sort_array(F.collect_list(F.struct("n", "term", "off")))
    rows = flat.groupBy("terms").agg(F.first("items").alias("items"), F.count("n").alias("have"), parts.alias("p")).where(F.col("have") == F.size("terms"))
    return stash(rows.select(F.col("p")[0]["term"].alias("term"), "items", F.transform("p", lambda x: F.struct(x["term"].alias("term"), x["off"].alias("off"))).alias("parts")), "windows")


def moved(list_: Column, off: Column) -> Column:
    """A term's list, moved by the term's place in the window."""
    return F.transform(list_, lambda p: p - off)


def looked_up(index: DataFrame, wins: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """row, n_words, postings, list, items, parts: each document with each window whose rarest term
    it has, and that term's list. The window's next term must be there as well."""
    has = index.select("row", "n_words", "postings", F.explode("postings").alias("term", "list"))
    if wins.count() <= most:
        pairs = has.join(F.broadcast(wins), "term")
    else:
        some = has.select("row", "term", "list").join(wins.hint("merge"), "term")
        pairs = some.join(index.select("row", "n_words", "postings").hint("merge"), "row")
    return pairs.where((F.size("parts") == 1) | F.map_contains_key("postings", F.get(F.col("parts"), F.least(F.lit(1), F.size("parts") - 1))["term"]))


def _found(docs: DataFrame, items: DataFrame, window: int, places, id_col: str, text_col: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Matches (row, item_id, start, length), and the index."""
    wins = windows_of(items, window)
    terms = wins.select(F.explode("terms").alias("term")).distinct()
    index = stash(index_of(docs, terms, id_col, text_col), "postings")
    pairs = looked_up(index, ranked(wins, index), most)
    at = pairs.select("row", "items", F.explode(places()).alias("m"))
    return stash(at.select("row", F.explode("items").alias("item_id"), "m.start", "m.length").distinct(), "matches"), index


def _phrase_places() -> Column:
    """The lists of a window's terms, moved and intersected from the rarest on."""
    parts = F.col("parts")
    none = F.array().cast("array<int>")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    meet = lambda left, x: F.coalesce(F.array_intersect(left, moved(F.try_element_at("postings", x["term"]), x["off"])), none)
    starts = F.aggregate(rest, moved(F.col("list"), parts[0]["off"]), lambda left, x: F.when(F.size(left) == 0, left).otherwise(meet(left, x)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.size(parts).alias("length")))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_WINDOWS) -> DataFrame:
    """id, item_id, start, length: every occurrence of every window."""
    matches, index = _found(docs, items, window, _phrase_places, id_col, text_col, most)
    return matches.join(index.select("row", "id"), "row").select("id", "item_id", "start", "length")


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int = 15, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_WINDOWS) -> DataFrame:
    """id, item_id, start, length: runs of ``span`` tokens (at a text's end: fewer) with all
    the distinct terms of a window, in any order; of overlapping runs around one rare
    term the first."""

    def places() -> Column:
        terms = F.array_distinct(F.transform("parts", lambda x: x["term"]))
        near = lambda t, s: F.exists(F.coalesce(F.try_element_at("postings", t), F.array().cast("array<int>")), lambda p: (p >= s) & (p < s + span))
        full = lambda s: F.forall(terms, lambda t: near(t, s))
        first = F.transform("list", lambda p: F.get(F.filter(F.sequence(F.greatest(F.lit(0), p - (span - 1)), p), full), F.lit(0)))
        return F.transform(F.filter(first, lambda s: s.isNotNull()), lambda s: F.struct(s.alias("start"), F.least(F.lit(span), F.col("n_words").cast("int") - s).alias("length")))

    matches, index = _found(docs, items, window, places, id_col, text_col, most)
    return matches.join(index.select("row", "id"), "row").select("id", "item_id", "start", "length")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_WINDOWS) -> DataFrame:
    """id, n_words, n_hit (words inside any match), n_items, items_sha256, contaminated."""
    matches, index = _found(docs, items, window, _phrase_places, id_col, text_col, most)
    places = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    found = matches.groupBy("row").agg(places.cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return index.select("row", "id", "n_words").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without a match."""
    rows = numbered(docs, "rows")
    flat = rows.select("_row", F.col("doc")[text_col].alias("text"))
    matches, index = _found(flat, items, window, _phrase_places, "_row", "text", BROADCAST_WINDOWS)
    bad = matches.select("row").distinct().join(index.select("row", F.col("id").alias("_row")), "row").select("_row")
    # these numbers grow with the input, so they are never broadcast, at any size
    return rows.join(bad.hint("shuffle_hash"), "_row", "left_anti").select("doc.*")


def op4_decontaminate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, w[s:s + 9] AS terms, len(w[s:s + 9]) AS n FROM starts),
places AS (SELECT d.r, d.w, k.n, unnest(range(1, len(d.w) - k.n + 2)) AS s FROM docs d JOIN (SELECT DISTINCT n FROM wins) k ON len(d.w) >= k.n),
found AS (SELECT DISTINCT a.r, a.s, a.n, x.item_id FROM places a JOIN wins x ON x.n = a.n AND x.terms = a.w[a.s:a.s + a.n - 1]),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON h.r = d.r LEFT JOIN names m ON m.r = d.r
"""
