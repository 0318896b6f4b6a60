"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token ids; longer ones than a sequence are cut into pieces. A piece of full length
is a sequence of its own. The others are dealt by hash to shards of about ``SHARD`` pieces. On
each shard ``ISLANDS`` populations of packings evolve apart. A packing is a list of bins (the
genes). The first ones are best fits in random order, a per cent or two above the least
possible number; crossover injects well-filled whole bins of one parent into the other,
removes the bins that hold a piece twice, and puts displaced pieces back by best fit in falling
order; mutation dissolves the emptiest and some other bins. Between epochs an island keeps
its elite packing and gets that of the island before it in a ring. A shard that reaches
the bound ceil(sum / size) stops. Then the bins that are not well filled, of all shards, are
dissolved and their pieces packed again together, by the same algorithm, until one shard
holds them or a round no longer saves a sequence.

Defined cases: a null or empty text is one piece of its end id; a very long one is cut into as
many pieces as it needs; repeated rows are packed each; null ids are allowed; equal lengths
are interchangeable; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, stash, table
from .tokens import WORD_BPE, encoder, tokenizer_path

SIZE = 2048
END_ID = 0
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 8
GENERATIONS = 50
WELL_FILLED = 0.97


def best_fit(lengths: np.ndarray, items: np.ndarray, slots: np.ndarray, fills: np.ndarray, size: int) -> np.ndarray:
    """Sets the slots of items, in the given order: each goes into the bin with the least
    room that is enough for it, or a new one. fills: of the bins there are. Room is
    looked up in a bit mask of the rooms there are."""
    if not len(items):
        return slots
    by_room: dict[int, list[int]] = {}
    mask = 0
    room = size - np.asarray(fills, dtype=np.int64)
    for i in np.flatnonzero(room >= lengths[items].min()).tolist():
        r = int(room[i])
        by_room.setdefault(r, []).append(i)
        mask |= 1 << r
    new, out = len(room), []
    for need in lengths[items].tolist():
        free = mask >> need
        if free:
            r = need + (free & -free).bit_length() - 1
            at = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            r, at = size, new
            new += 1
        out.append(at)
        by_room.setdefault(r - need, []).append(at)
        mask |= 1 << (r - need)
    slots[items] = out
    return slots


def pack(lengths: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece, by best fit in that order."""
    return best_fit(lengths, order, np.zeros(len(lengths), np.int64), np.empty(0, np.int64), size)


def fills_of(lengths: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return np.bincount(slots, weights=lengths).astype(np.int64)


def fitness(lengths: np.ndarray, slots: np.ndarray, size: int) -> tuple[int, float]:
    """Smaller is better: bins, then minus the mean squared fill."""
    fill = fills_of(lengths, slots) / size
    return len(fill), -float((fill**2).mean()) if len(fill) else 0.0


def _without(slots: np.ndarray, out: np.ndarray, child: np.ndarray, first: int) -> np.ndarray:
    """Copies the bins that are not ``out`` into ``child``, numbered from ``first`` on."""
    stay = ~out
    kept = stay[slots]
    child[kept] = (np.cumsum(stay) - 1)[slots[kept]] + first
    return kept


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, rng) -> np.ndarray:
    """b with half of the well-filled whole bins of a injected."""
    fill_a, fill_b = fills_of(lengths, a), fills_of(lengths, b)
    good = fill_a >= WELL_FILLED * size
    picked = (good if good.any() else ~good) & (rng.random(len(fill_a)) < 0.5)
    inside = picked[a]
    child = np.zeros(len(a), np.int64)
    _without(a, ~picked, child, 0)
    twice = np.bincount(b[inside], minlength=len(fill_b)) > 0
    _without(np.where(inside, -1, b), np.append(twice, True), child, int(picked.sum()))
    displaced = np.flatnonzero(twice[b] & ~inside)
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    return best_fit(lengths, displaced, child, np.concatenate([fill_a[picked], fill_b[~twice]]), size)


def mutate(lengths: np.ndarray, a: np.ndarray, size: int, rng) -> np.ndarray:
    """Dissolves the emptiest bins and some others, and best-fits their pieces."""
    fill = fills_of(lengths, a)
    out = rng.random(len(fill)) < 0.05
    out[np.argsort(fill, kind="stable")[:2]] = True
    child = np.zeros(len(a), np.int64)
    loose = np.flatnonzero(~_without(a, out, child, 0))
    loose = loose[np.argsort(-lengths[loose] * (1 + 0.1 * rng.random(len(loose))), kind="stable")]
    return best_fit(lengths, loose, child, fill[~out], size)


def evolve(lengths: np.ndarray, seed: int, size: int = SIZE, elites: tuple = (), population: int = POPULATION, generations: int = GENERATIONS, crossing: bool = True) -> tuple[np.ndarray, int]:
    """One island's elite after some generations, and how many crossovers were done.
    ``elites``: packings to start with, besides best fits in random order."""
    if not len(lengths):
        return np.empty(0, np.int64), 0
    rng = np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // size)
    pool = [np.asarray(e, dtype=np.int64) for e in elites]
    pool += [pack(lengths, rng.permutation(len(lengths)), size) for _ in range(population - len(pool))]
    pool = sorted(((fitness(lengths, p, size), k, p) for k, p in enumerate(pool)), key=lambda x: x[:2])
    crossed = 0
    for g in range(generations):
        if pool[0][0][0] <= bound:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        child = pool[min(i, j)][2]
        if crossing:
            child, crossed = crossover(lengths, pool[i][2], pool[j][2], size, rng), crossed + 1
        for k, kid in enumerate((child, mutate(lengths, child, size, rng))):
            fit = fitness(lengths, kid, size)
            if all(fit != p[0] for p in pool):
                pool.append((fit, population * (g + 1) + k, kid))
        pool = sorted(pool, key=lambda x: x[:2])[:population]
    return pool[0][2], crossed


def _evolve_shards(shards: DataFrame, size: int, islands: int, epochs: int) -> DataFrame:
    """shards: shard, pieces array<struct<length int, key>>. Adds slots array<int>."""
    spark = shards.sparkSession
    n = partitions(spark)

    def run(batches, epoch):
        for b in batches:
            slots, bins = [], []
            for shard, island, lengths, elites in zip(*(b.column(c).to_pylist() for c in ("shard", "island", "lengths", "elites"))):
                start = [elites[island], elites[island - 1]][: len(elites)] if elites else ()
                best = evolve(np.array(lengths, dtype=np.int64), (shard * islands + island) * 64 + epoch, size, start)[0]
                slots.append(best.astype(np.int32))
                bins.append(int(best.max()) + 1 if len(best) else 0)
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("island"), b.column("lengths"), pa.array(slots, pa.list_(pa.int32())), pa.array(bins, pa.int32())], names=["shard", "island", "lengths", "slots", "n_bins"])

    state = shards.select("shard", F.col("pieces.length").alias("lengths")).withColumn("elites", F.lit(None).cast("array<array<int>>"))
    for epoch in range(epochs):
        isles = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        # dealt by an explicit task number: a search costs seconds and its row little
        dealt = isles.withColumn("task", F.pmod(F.col("shard") * islands + F.col("island"), F.lit(n))).repartitionById(n, "task").drop("task")
        done = cut(dealt.mapInArrow(lambda it, e=epoch: run(it, e), "shard int, island int, lengths array<int>, slots array<int>, n_bins int"))
        elites = F.transform(F.sort_array(F.collect_list(F.struct("island", "slots"))), lambda x: x["slots"])
        state = done.groupBy("shard").agg(F.first("lengths").alias("lengths"), elites.alias("elites"))
    best = done.groupBy("shard").agg(F.min_by("slots", F.struct("n_bins", "island")).alias("slots"))
    return shards.join(best, "shard")


def pack_pieces(pieces: DataFrame, size: int = SIZE, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, full: float = 0.995) -> DataFrame:
    """pieces: key (unique, orderable), length (1 to size). Returns key, length,
    sequence_id (not negative), offset."""
    todo, done, level, before = pieces.select("key", F.col("length").cast("int").alias("length")), None, 0, None
    while True:
        n = todo.count()
        n_shards = max(1, -(-n // shard))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64(F.col("key"), F.lit(level)), F.lit(n_shards)).cast("int"))
        shards = stash(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("pieces")), "packing-shards")
        placed = _evolve_shards(shards, size, islands, epochs)
        flat = placed.select("shard", F.explode(F.arrays_zip("pieces", "slots")).alias("p")).select("shard", F.col("p.pieces.key").alias("key"), F.col("p.pieces.length").alias("length"), F.col("p.slots").alias("slot"))
        fill = F.struct(F.col("key").alias("key"), F.col("length").alias("length"))
        bins = flat.groupBy("shard", "slot").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list(fill)).alias("items"))
        bins = stash(bins.withColumn("sequence_id", F.lit(level) * F.lit(1 << 56) + F.col("shard").cast("long") * F.lit(1 << 24) + F.col("slot")), "packed-bins")
        loose = bins.where(F.col("fill") < int(full * size))
        left = loose.agg(F.count("*").alias("n"), F.sum("fill").alias("fill")).first()
        # done when all was in one shard, when the loose bins can't be fewer, or when a round saved none
        last = n_shards == 1 or left["n"] <= -(-(left["fill"] or 0) // size) or (before is not None and left["n"] >= before)
        good = bins if last else bins.where(F.col("fill") >= int(full * size))
        done = good if done is None else done.unionByName(good)
        if last:
            break
        todo = loose.select(F.explode("items").alias("i")).select("i.key", "i.length")
        level, before = level + 1, left["n"]
    ahead = F.expr("transform(items, (x, i) -> named_struct('key', x.key, 'length', x.length, 'offset', aggregate(slice(items, 1, i), 0L, (s, y) -> s + y.length)))")
    return done.select("sequence_id", F.explode(ahead).alias("i")).select("i.key", "i.length", "sequence_id", "i.offset")


def pieces_of(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece of every document."""
    tokenizer = tokenizer or tokenizer_path(WORD_BPE)
    flat = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            rows, own = [], []
            for at, ids in enumerate(enc.each(b.column("text"))):
                raw = ids.tobytes() + end
                for p in range(0, len(raw), 4 * size):
                    part = raw[p : p + 4 * size]
                    rows.append((p // (4 * size), p // 4, len(part) // 4, zlib.crc32(part)))
                    own.append(at)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(own, pa.int64())), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2, 3))], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = dict(flat.dtypes)["id"]
    return flat.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    # the key is fixed once the pieces are written
    keyed = stash(pieces_of(docs, tokenizer, size, end_id, id_col, text_col).withColumn("key", F.monotonically_increasing_id()), "pieces")
    columns = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = keyed.where(F.col("length") == size).withColumn("sequence_id", F.lit(-1) - F.col("key")).withColumn("offset", F.lit(0).cast("long"))
    part = keyed.where(F.col("length") < size)
    packed = pack_pieces(part.select("key", "length"), size, **options).select("key", "sequence_id", "offset")
    return whole.select(columns).unionByName(part.join(packed, "key").select(columns))


def op8_pack_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
