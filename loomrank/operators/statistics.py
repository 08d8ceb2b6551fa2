"""Correlation, resampling and multiple testing as DataFrame programs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spread


def pearson(x: str, y: str) -> Column:
    """NULL for fewer than three complete rows or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) >= 3, r)


def with_ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Average-tie ranks ``r_<column>`` within keys, however many rows a key has."""
    for c in columns:
        df = spread.average_ranks(df, keys, c, f"r_{c}")
    return df


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys, n, rho`` over rows complete in both."""
    rows = with_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, [x, y])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), pearson(f"r_{x}", f"r_{y}").alias("rho"))


def draw(replicate: Column, item: Column, n: Column) -> Column:
    """A number in 0..n-1 from the md5 of ``replicate:item``; any engine can repeat it."""
    key = F.concat_ws(":", replicate.cast("string"), item.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), n)


def cluster_sums(df: DataFrame, cluster: str, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Six sufficient sums of a correlation per cluster, clusters numbered from 0 by name (within ``keys``)."""
    keys = keys or []
    s = df.groupBy(*keys, cluster).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    return spread.number_rows(s, keys, [cluster], "c").withColumn("c", F.col("c") - 1)


def from_sums(n, sx, sy, sxx, syy, sxy) -> Column:
    cov = n * sxy - sx * sy
    return F.try_divide(cov, F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy))


#: replicates that one task works out together
BLOCK = 256
#: clusters, or cells, of a key that one task may hold; with more of them replicates are joined to rows
HELD = 1 << 22
#: draws, items x replicates, held at once
MATRIX = 1 << 20
_MD5_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4)
_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: digests worked out at once: few calls, and not much memory
_AT_ONCE = 1 << 16


def _first_words(start: bytes, low: int, high: int) -> np.ndarray:
    """The first 32 bits of the md5 of ``start`` and each number in low..high-1, all of as many digits; for messages of one block."""
    digits = len(str(low))
    size = len(start) + digits
    head = np.frombuffer(start + b"\0" * digits + b"\x80" + b"\0" * (55 - size) + (8 * size).to_bytes(8, "little"), "<u4")
    words: list = [int(w) for w in head]
    number = np.arange(low, high, dtype=np.uint32)
    for place in range(size - 1, len(start) - 1, -1):
        number, digit = np.divmod(number, np.uint32(10))
        words[place // 4] = words[place // 4] + ((digit + np.uint32(48)) << np.uint32(8 * (place % 4)))
    words = [w if isinstance(w, np.ndarray) else np.uint32(w) for w in words]
    n = high - low
    a, b, c, d = (np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps do not touch what is asked for
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(words[at], np.ndarray):
            f += words[at]
            f += np.uint32(_MD5_ADDED[i])
        else:
            f += np.uint32((_MD5_ADDED[i] + int(words[at])) & 0xFFFFFFFF)
        turn = int(_MD5_TURNS[i])
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(0x67452301)).byteswap()


def _one_by_one(start: bytes, low: int, high: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.md5(start + str(i).encode()).digest()[:4] for i in range(low, high)), ">u4").astype(np.uint32)


#: below so many digests they are faster one by one
FEW_DRAWS = 2048


def raw_draws(replicate: int, prefix: str, low: int, high: int) -> np.ndarray:
    """The numbers of :func:`draw` for the items low..high-1, before they are taken modulo ``n``."""
    start = f"{replicate}:{prefix}".encode()
    if len(start) > 44:  # the message might take a second block
        return _one_by_one(start, low, high)
    out = [np.zeros(0, np.uint32)]
    while low < high:
        end = min(high, low + _AT_ONCE, 10 ** len(str(low)))
        if end - low < FEW_DRAWS:
            out.append(_one_by_one(start, low, end))
        else:
            out.append(_first_words(start, low, end))
        low = end
    return np.concatenate(out)


def counted(raw: np.ndarray, n: int) -> np.ndarray:
    """How often each of n items is drawn in each replicate, a row of ``raw`` draws."""
    at = (raw[:, :n] % np.uint32(n)).astype(np.int64) + n * np.arange(len(raw))[:, None]
    return np.bincount(at.ravel(), minlength=n * len(raw)).reshape(-1, n)


def counts_drawn(replicates: Iterable[int], prefix: str, n: int) -> np.ndarray:
    """:func:`counted` draws of the replicates."""
    return counted(np.array([raw_draws(b, prefix, 0, n) for b in replicates], np.uint32).reshape(-1, n), n)


def in_blocks(df: DataFrame, keys: list[str], replicates: int, run: Callable[[tuple, pd.DataFrame, range], pd.DataFrame], schema: str) -> DataFrame:
    """``run(key, rows, replicates)`` for every key and block of replicates; rows are sent once for each block, not for each replicate."""
    spark, n = df.sparkSession, -(-replicates // BLOCK)
    blocks = spark.range(n).select(F.col("id").alias("_block"))
    # few small rows with much work behind them: they must not end up in one task
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * BLOCK
        return run(key[:-1], pdf, range(first, min(first + BLOCK, replicates)))

    spread_ = df.crossJoin(F.broadcast(blocks)).repartition(2 * tasks, *keys, "_block")
    return spread_.groupBy(*keys, "_block").applyInPandas(one, schema)


#: draws that a task of many keys holds
DRAWS = 1 << 25
#: bytes of a key's rows that are sent as one
PIECE = 1 << 12


def _in_pieces(rows: pa.Table, pack: Callable[[pa.Table], tuple[int, np.ndarray]]) -> pa.Table:
    """What ``pack`` makes of a key's rows, the number of its items and a table of numbers, as pieces of ``PIECE`` bytes."""
    items, numbers = pack(rows)
    data = np.ascontiguousarray(numbers)
    cuts = np.append(np.arange(0, data.nbytes, PIECE), data.nbytes)
    pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    same = {"_key": rows.column("_key")[0].as_py(), "_items": items, "_size": data.nbytes}
    return pa.table({**{k: np.full(len(pieces), v, np.int64) for k, v in same.items()}, "_at": cuts[:-1], "_data": pieces})


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Block, key, number of items and bytes of each key whose pieces have come."""
    begun: dict[int, list] = {}
    for batch in batches:
        block, key, items, size, at = (batch.column(c).to_numpy() for c in ("_block", "_key", "_items", "_size", "_at"))
        data = batch.column("_data")
        cuts = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        held = np.frombuffer(data.buffers()[2], np.uint8)
        # pieces that follow each other are copied at once
        ends = np.flatnonzero((key[1:] != key[:-1]) | (at[1:] != at[:-1] + np.diff(cuts)[:-1])) + 1
        for low, high in zip([0, *ends], [*ends, len(key)], strict=True):
            own = begun.setdefault(key[low], [0, np.empty(size[low], np.uint8)])
            n = int(cuts[high] - cuts[low])
            own[1][at[low] : at[low] + n] = held[cuts[low] : cuts[high]]
            own[0] += n
            if own[0] == size[low]:
                del begun[key[low]]
                yield int(block[low]), int(key[low]), int(items[low]), own[1]


def with_draws(df: DataFrame, keys: list[str], replicates: int, prefix: str, pack: Callable[[pa.Table], tuple[int, np.ndarray]], kind: type, width: int, ready: Callable[[int, np.ndarray], Callable], out: str) -> DataFrame:
    """``keys, b, out`` of resampled keys.

    ``pack(rows of a key)`` gives the number of its items and a table of numbers, ``width`` of a ``kind`` in a row, and ``ready`` of both
    makes values of a matrix of draws and its replicates. A draw does not depend on the key but for its
    modulo: a task makes the draws of some replicates once, and all keys pass it, one after the other. Tasks
    read packed rows from the shared folder, which are written once.
    """
    spark = df.sparkSession
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    known = spread.cut(spread.number_rows(sizes, [], keys, "_key") if keys else sizes.select(F.lit(1).cast("long").alias("_key")))
    rows = spread.join_on_keys(df, known.select(*keys, "_key"), keys).drop(*keys)
    pieces = spread.cut(rows.groupBy("_key").applyInArrow(lambda t: _in_pieces(t, pack), "_key long, _items long, _size long, _at long, _data binary"))
    most = pieces.agg(F.max("_items")).first()[0] or 1
    at_once = max(1, min(BLOCK, DRAWS // most))
    tasks = -(-replicates // at_once)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = None
        for block, key, items, data in _put_together(batches):
            reps = range(block * at_once, min((block + 1) * at_once, replicates))
            if raw is None:
                raw = np.empty((len(reps), most), np.uint32)
                for i, b in enumerate(reps):
                    raw[i] = raw_draws(b, prefix, 0, most)
            values, step = ready(items, data.view(kind).reshape(-1, width)), max(1, MATRIX // items)
            found = np.concatenate([values(raw[i : i + step], reps[i : i + step]) for i in range(0, len(reps), step)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), key)), pa.array(np.array(reps)), pa.array(found, pa.float64())], ["_key", "b", "_v"])

    blocks = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("_block"))
    # one partition beside each block of replicates, so that a task reads all keys by itself and nothing is shuffled
    found = pieces.coalesce(1).join(blocks.hint("shuffle_replicate_nl"), how="cross").mapInArrow(one, "_key long, b long, _v double")
    return found.join(known.select("_key", *keys), "_key").select(*keys, "b", F.nanvl("_v", F.lit(None)).alias(out))


def most_rows(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _numbers(rows: pa.Table, columns: list[str], kind: type) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy().astype(kind) for c in columns])


def _places(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each value among the distinct ones in order."""
    if pa.types.is_string(column.type):
        names = column.combine_chunks().dictionary_encode("encode")
        return np.unique(names.dictionary.to_numpy(False), return_inverse=True)[1][np.asarray(names.indices)]
    return np.unique(column.to_numpy(), return_inverse=True)[1]


def _typed(df: DataFrame, keys: list[str], rest: str) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + rest


SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _correlations(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    """:func:`from_sums` of arrays; NaN where a side does not vary."""
    below = np.sqrt(np.maximum(n * sxx - sx * sx, 0)) * np.sqrt(np.maximum(n * syy - sy * sy, 0))
    return np.divide(n * sxy - sx * sy, below, out=np.full(len(n), np.nan), where=below > 0)


def bootstrap_replicates(sums: DataFrame, replicates: int, keys: list[str] | None = None, held: int = HELD) -> DataFrame:
    """``keys, b, r``: correlation of each replicate of resampled clusters, within ``keys``.

    Sums are one row per cluster. A task draws for a block of replicates, a few at a
    time, and multiplies the counts with the sums. Keys of more than ``held`` clusters join draws to sums instead.
    """
    keys, sums = keys or [], spread.cut(sums)
    if most_rows(sums, keys) > held:
        return _joined_replicates(sums, replicates, keys)

    def pack(rows: pa.Table) -> tuple[int, np.ndarray]:
        return rows.num_rows, _numbers(rows.sort_by("c"), SUMS, float)

    def ready(n: int, own: np.ndarray) -> Callable:
        own = np.ascontiguousarray(own.T)

        def values(raw: np.ndarray, _: range) -> np.ndarray:
            # one replicate after the other stays in a core's cache once there are many clusters
            found = own @ counted(raw, n).T if n < FEW_DRAWS else np.array([own @ counted(r[None], n)[0].astype(float) for r in raw]).T
            return _correlations(*found)

        return values

    return with_draws(sums.select(*keys, "c", *SUMS), keys, replicates, "", pack, float, len(SUMS), ready, "r")


def _joined_replicates(sums: DataFrame, replicates: int, keys: list[str]) -> DataFrame:
    n = sums.groupBy(*keys).agg(F.count("*").alias("_k"))
    reps = n.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    draws = reps.select(*keys, "b", "_k", F.explode(F.expr("sequence(0L, _k - 1)")).alias("i"))
    draws = draws.select(*keys, "b", draw(F.col("b"), F.col("i"), F.col("_k")).alias("c"))
    tot = draws.join(sums, [*keys, "c"]).groupBy(*keys, "b").agg(*[F.sum(c).alias(c) for c in SUMS])
    return tot.select(*keys, "b", from_sums(*[F.col(c) for c in SUMS]).alias("r"))


def sign_flip(sums: DataFrame, replicates: int, keys: list[str] | None = None, held: int = HELD) -> DataFrame:
    """``keys, p``: share of replicates, the seen one counted in, whose covariance is as large when clusters change sign.

    Sums that differ by rounding alone, as those of the seen signs and their opposites, count as equal.
    """
    keys, sums = keys or [], spread.cut(sums)
    m = sums.groupBy(*keys).agg((F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my"))
    with_means = sums.join(m, keys) if keys else sums.crossJoin(F.broadcast(m))
    z = with_means.select(*keys, "c", F.expr("sxy - mx * sy - my * sx + n * mx * my").alias("z"))
    if most_rows(sums, keys) > held:
        flips = z.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
        sign = F.when(draw(F.col("b"), F.col("c"), F.lit(2)) == 0, 1).otherwise(-1)
        f = flips.groupBy(*keys, "b").agg(F.sum(F.col("z") * sign).alias("s"), (F.abs(F.sum("z")) - 1e-12 * F.sum(F.abs("z"))).alias("seen"))
        return f.groupBy(*keys).agg(((1 + F.count_if(F.abs("s") >= F.col("seen"))) / F.lit(replicates + 1.0)).alias("p"))

    def pack(rows: pa.Table) -> tuple[int, np.ndarray]:
        return rows.num_rows, _numbers(rows.sort_by("c"), ["z"], float)

    def ready(n: int, own: np.ndarray) -> Callable:
        own = own[:, 0]
        total = own.sum()
        seen = abs(total) - 1e-12 * np.abs(own).sum()
        # an odd draw turns the sign
        return lambda raw, _: (np.abs(total - 2.0 * ((raw[:, :n] & np.uint32(1)).astype(float) @ own)) >= seen).astype(float)

    found = with_draws(z.select(*keys, "c", "z"), keys, replicates, "", pack, float, 1, ready, "large")
    return found.groupBy(*keys).agg(((1 + F.sum("large")) / F.lit(replicates + 1.0)).alias("p"))


def bootstrap_means(rows: DataFrame, replicates: int, group: str, order: str, value: str, held: int = HELD) -> DataFrame:
    """``group, b, m``: the mean of each replicate of a group's resampled values; draws are named by the group."""
    rows = spread.cut(rows.select(group, order, value))
    x = spread.number_rows(rows, [group], [order], "_i", "_k").withColumn("_i", F.col("_i") - 1)
    if most_rows(rows, [group]) > held:
        reps = rows.sparkSession.range(replicates).select(F.col("id").alias("b"))
        d = x.crossJoin(F.broadcast(reps)).select("b", group, draw(F.col("b"), F.concat(group, F.col("_i").cast("string")), F.col("_k")).alias("_i"))
        return d.join(x.select(group, "_i", value), [group, "_i"]).groupBy(group, "b").agg(F.avg(value).alias("m"))

    def run(key: tuple, pdf: pd.DataFrame, reps: range) -> pd.DataFrame:
        own = pdf.sort_values("_i")[value].to_numpy(float)
        step = max(1, MATRIX // len(own))
        means = np.concatenate([counts_drawn(reps[at : at + step], str(key[0]), len(own)) @ own / len(own) for at in range(0, len(reps), step)])
        return pd.DataFrame({group: [key[0]] * len(means), "b": list(reps), "m": means})

    return in_blocks(x.select(group, "_i", value), [group], replicates, run, _typed(rows, [group], "b long, m double"))


def crossed_bootstrap(cells: DataFrame, replicates: int, keys: list[str] | None = None, held: int = HELD) -> DataFrame:
    """Crossed two-way bootstrap over a (donor, carrier) cell table: ``keys, b, r`` of weighted rank correlations.

    A cell weighs the times its donor was drawn times the times its carrier was.
    Names are numbered in order, draws are numbers from a hash of the replicate and a
    place. A task numbers the values of a key once; weighted mid-ranks of a replicate are
    cumulative sums of the weights of values. Keys of more than
    ``held`` cells join draws to cells instead. Cells without one of the values take no
    part; replicates of no weight, or of one value, have no ``r``.
    """
    keys = keys or []
    cells = spread.cut(cells.where("x is not null and y is not null"))
    if most_rows(cells, keys) > held:
        return _joined_crossed(cells, replicates, keys)

    def pack(rows: pa.Table) -> tuple[int, np.ndarray]:
        at = np.column_stack([_places(rows.column(c)) for c in ("donor", "carrier", "x", "y")]).astype(np.int32)
        return int(at[:, 0].max()) + 1, at[np.argsort(at[:, 0], kind="stable")]

    def ready(n: int, cells: np.ndarray) -> Callable:
        donor, carrier, x, y = cells.T.astype(np.int64)
        carriers, nx, ny = (int(v.max()) + 1 for v in (carrier, x, y))

        def one(drawn: np.ndarray, b: int) -> tuple[float, ...]:
            w = drawn[donor] * counts_drawn([b], "carrier/", carriers)[0].astype(float)[carrier]
            sums, ranks = [], []
            for group, k in ((x, nx), (y, ny)):
                own = np.bincount(group, w, k)
                mid = np.cumsum(own) - (own - 1) / 2.0
                sums.append((own @ mid, own @ (mid * mid)))
                ranks.append(mid[group])
            (sx, sxx), (sy, syy) = sums
            return w.sum(), sx, sy, sxx, syy, w @ (ranks[0] * ranks[1])

        def values(raw: np.ndarray, reps: range) -> np.ndarray:
            drawn = (counted(raw[i : i + 1], n)[0].astype(float) for i in range(len(reps)))
            return _correlations(*np.array([one(d, b) for d, b in zip(drawn, reps, strict=True)]).T)

        return values

    return with_draws(cells.select(*keys, "donor", "carrier", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), keys, replicates, "donor/", pack, np.int32, 4, ready, "r")


def _joined_crossed(cells: DataFrame, replicates: int, keys: list[str]) -> DataFrame:
    reps = cells.sparkSession.range(replicates).select(F.col("id").alias("b"))

    def counts(name: str) -> DataFrame:
        names = spread.number_rows(cells.select(*keys, name).distinct(), keys, [name], "_i", "_k").withColumn("_i", F.col("_i") - 1)
        drawn = names.crossJoin(F.broadcast(reps)).select(*keys, "b", draw(F.col("b"), F.concat(F.lit(f"{name}/"), F.col("_i").cast("string")), F.col("_k")).alias("_i"))
        return drawn.groupBy(*keys, "b", "_i").agg(F.count("*").alias(f"n_{name}")).join(names.select(*keys, "_i", name), [*keys, "_i"]).select(*keys, "b", name, f"n_{name}")

    w = cells.join(counts("donor"), [*keys, "donor"]).join(counts("carrier"), [*keys, "b", "carrier"]).select(*keys, "b", "x", "y", (F.col("n_donor") * F.col("n_carrier")).alias("w"))
    for v in ("x", "y"):
        g = w.groupBy(*keys, "b", v).agg(F.sum("w").alias("g"))
        g = spread.running(g, [*keys, "b"], [v], {"upto": ("sum", F.col("g"))})
        w = w.join(g.select(*keys, "b", v, (F.col("upto") - (F.col("g") - 1) / 2.0).alias(f"r{v}")), [*keys, "b", v])
    sums = [F.sum(F.expr(e)).cast("double").alias(n) for n, e in (("n", "w"), ("sx", "w * rx"), ("sy", "w * ry"), ("sxx", "w * rx * rx"), ("syy", "w * ry * ry"), ("sxy", "w * rx * ry"))]
    tot = w.groupBy(*keys, "b").agg(*sums)
    return tot.select(*keys, "b", from_sums(*[F.col(c) for c in SUMS]).alias("r"))


def nested_spearman(df: DataFrame, keys: list[str], x: str, y: str, by: str, thresholds: list[float]) -> DataFrame:
    """``keys, threshold, rho, n, retained``: rank correlation of the rows with ``by`` <= each threshold, and their percent of all rows.

    Rows are counted once by their values and their band, the first threshold they
    pass. For every value, counts are summed up over bands, and running sums of these
    are its ranks in every subset at once; no row is repeated in a shuffle. Rows
    without one of the values take no part; a subset without rows has no result.
    """
    at = sorted(thresholds)
    band = F.coalesce(*[F.when(F.col(by) <= t, i) for i, t in enumerate(at)]) if at else F.lit(None).cast("int")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(by).isNotNull())
    counted = spread.cut(rows.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.coalesce(band, F.lit(len(at))).alias("_band")).groupBy(*keys, "_x", "_y", "_band").agg(F.count("*").alias("_n")))
    ranked = counted.where(F.col("_band") < len(at))
    for v in ("_x", "_y"):
        if v == "_x" and by == x:  # larger values join behind the others, so ranks stay
            held = spread.running(ranked.groupBy(*keys, v).agg(F.sum("_n").alias("_c")), keys, [v], {"_u": ("sum", F.col("_c"))})
            ranks = F.array_repeat(F.col("_u") - (F.col("_c") - 1) / 2.0, len(at))
            ranked = spread.join_on_keys(ranked, held.select(*keys, v, ranks.alias("_r_x")), [*keys, v])
            continue
        upto = [f"_u{i}" for i in range(len(at))]
        held = ranked.groupBy(*keys, v).agg(*[F.sum(F.when(F.col("_band") <= i, F.col("_n")).otherwise(0)).alias(f"_c{i}") for i in range(len(at))])
        held = spread.running(held, keys, [v], {u: ("sum", F.col(f"_c{i}")) for i, u in enumerate(upto)})
        ranks = F.array(*[F.col(u) - (F.col(f"_c{i}") - 1) / 2.0 for i, u in enumerate(upto)])
        ranked = spread.join_on_keys(ranked, held.select(*keys, v, ranks.alias(f"_r{v}")), [*keys, v])
    each = ranked.select(*keys, F.col("_n").cast("double").alias("n"), F.explode(F.sequence("_band", F.lit(len(at) - 1))).alias("_t"), "_r_x", "_r_y")
    each = each.select(*keys, "_t", "n", F.expr("_r_x[_t]").alias("rx"), F.expr("_r_y[_t]").alias("ry"))
    sums = [F.sum(F.expr(e)).alias(c) for c, e in zip(SUMS, ("n", "n * rx", "n * ry", "n * rx * rx", "n * ry * ry", "n * rx * ry"), strict=True)]
    total = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    out = spread.join_on_keys(each.groupBy(*keys, "_t").agg(*sums), total, keys) if keys else each.groupBy("_t").agg(*sums).crossJoin(F.broadcast(total))
    threshold = F.array(*[F.lit(float(t)) for t in at])[F.col("_t")]
    rho = F.when(F.col("n") >= 3, from_sums(*[F.col(c) for c in SUMS]))
    return out.select(*keys, threshold.alias("threshold"), rho.alias("rho"), F.col("n").cast("long").alias("n"), (100.0 * F.col("n") / F.col("_all")).alias("retained"))


def benjamini_hochberg(df: DataFrame, p: str, tie: str, keys: list[str]) -> DataFrame:
    """``q`` of each row: the least of p n / r over its own and larger ranks r of its key."""
    ranked = spread.number_rows(df, keys, [p, tie], "_r", "_n")
    found = spread.running(ranked, keys, [F.desc("_r")], {"q": ("min", F.col(p) * F.col("_n") / F.col("_r"))})
    return found.withColumn("q", F.least(F.lit(1.0), "q")).drop("_r", "_n")


def holm(df: DataFrame, p: str, tie: str, keys: list[str]) -> DataFrame:
    """``adjusted`` of each row: the largest of (n - r + 1) p over its own and smaller ranks r of its key."""
    ranked = spread.number_rows(df, keys, [p, tie], "_r", "_n")
    found = spread.running(ranked, keys, ["_r"], {"adjusted": ("max", (F.col("_n") - F.col("_r") + 1) * F.col(p))})
    return found.withColumn("adjusted", F.least(F.lit(1.0), "adjusted")).drop("_r", "_n")


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1 or a <= 0:
        return float(x >= 1 or a <= 0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def mcnemar_exact(a: Column, b: Column) -> Column:
    """Two-sided exact binomial p of discordant counts: the tail of a fair coin is an incomplete beta, whatever the counts."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        found = [None if math.isnan(x) or math.isnan(y) else min(1.0, 2 * beta_share(max(x, y), min(x, y) + 1, 0.5)) for x, y in zip(a.astype(float), b.astype(float), strict=True)]
        return pd.Series(found, dtype="float64")

    return run(a, b)


def t_two_sided(r: float | None, n: float | None) -> float | None:
    """p-value of a correlation of n rows by the t approximation."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    v = n - 2
    return beta_share(v / 2, 0.5, v / (v + r * r * v / (1 - r * r)))


def correlation_p(r: str, n: Column) -> Column:
    """p-values of result rows; the UDF is made here, on the driver."""

    @F.pandas_udf("double")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")

    return run(r, n)


def t_quantile(freedom: Column, share: float = 0.975) -> Column:
    """Student quantile of result rows, by bisection on the two-sided tail; NULL without degrees of freedom."""

    def tail(t: float, v: float) -> float:
        # the tail of t is that of the correlation which gives it
        return t_two_sided(t / math.sqrt(v + t * t), v + 2)

    def one(v: float | None) -> float | None:
        if v is None or math.isnan(v) or v <= 0:
            return None
        low, high = 0.0, 1.0
        while tail(high, v) > 2 * (1 - share):
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if tail(mid, v) > 2 * (1 - share) else (low, mid)
        return high

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in v], dtype="float64")

    return run(freedom.cast("double"))


def normal_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def run(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return run(z)
