"""Secret scans: fixed patterns, and a character network over every candidate.

Candidates are the findings of the base patterns and every run of 16 or more
key-like characters that holds a digit, or both a capital behind its first letter and a
small letter; of a run that base findings cover in part,
the parts they leave, by the same rule.  The network (:mod:`.secret_cnn`) reads a
candidate and its surroundings, a long candidate in overlapping windows, of which
the highest probability counts.  It is trained on labelled findings: known key
formats and look-alikes, built from words drawn from the whole corpus, and all of
the corpus's own: what base patterns found (of an assignment its value, as a
candidate would be) is a secret, other candidates are weakly labelled as none and
weigh ``WEAK``.  Tasks train on shards of these, and their networks are averaged after
each round.  A quarter of the documents and of the built findings is held out:
probabilities are calibrated there, and the threshold is the highest that keeps the
asked recall of the built findings, of the corpus's held-out ones, and of each key format that
training never saw, of each group by itself.  Base findings always stay; candidates above
the threshold are added as kind ``model``.
"""

from __future__ import annotations

import copy
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session_settings, unit_hash
from .secret_cnn import EPOCHS, LENGTH, SHORTEST, UNSEEN, Network, encode, labelled_findings

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
WORD = re.compile(r"[A-Za-z]{2,12}")
#: built findings, and of each unseen format; words drawn for them from the whole table, about one for each place they fill
BUILT, BUILT_UNSEEN, WORDS = 2400, 600, 40_000
#: rows of the table that a shard of training has, and files that shards are dealt to at most
CHUNK, FILES = 4096, 512
WEAK = 0.5
RECALL = 0.95
MASK = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of the base patterns, by start, then kind.

    Matches are leftmost and do not overlap within a kind; those that fail the
    length rule are dropped after matching.
    """
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Key-like runs, or the parts of them outside base findings."""
    covered: list[list[int]] = []
    for s, e, _ in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    found, i = [], 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        parts = []
        while i < len(covered) and covered[i][0] < e:
            parts.append((s, covered[i][0]))
            s = covered[i][1]
            if s >= e:
                break
            i += 1
        parts.append((s, e))
        for s, e in parts:
            if _key_like(text, s, e):
                found.append((s, e))
    return found


def _key_like(text: str, start: int, end: int) -> bool:
    """The rule for candidates: long enough, with a digit or with capitals among small letters."""
    run = text[start:end]
    letters = run.lstrip("+/_=-")
    return end - start >= SHORTEST and (any(c.isdigit() for c in run) or (letters[1:] != letters[1:].lower() and run != run.upper()))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(draw, x, y, held, w)``: every finding and candidate of every document, encoded, and ``WORDS`` drawn words of each task.

    What base patterns found has ``y`` 1, other candidates 0.  A word stands alone in its row; of all
    words of all tasks the ``WORDS`` of smallest ``draw`` are as if drawn from the whole table, each occurrence with equal chance.
    """
    id_text = (F.col(id_col), F.col(text_col))
    some = docs.select(F.col(text_col).alias("t"), F.xxhash64(*id_text, F.lit(3)).alias("h"), (unit_hash(*id_text, F.lit(2)) < 0.25).alias("held")).where("t is not null")

    def listed(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["draw", "x", "y", "held", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, bound = [], 1 << 63
        for batch in batches:
            out = []
            for t, h, held in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = t.as_py()
                base = base_spans(text)
                spans = [(ASSIGN.match(text, s).span(2) if k == 0 else (s, e), 1) for s, e, k in base]
                spans += [(span, 0) for span in candidates(text, base)]
                for (s, e), y in spans:
                    if _key_like(text, s, e):
                        out.append((zlib.crc32(f"{h} {s} {e}".encode()), encode(text, s, e).astype(np.uint8).tobytes(), y, held, None))
                words = WORD.findall(text)
                keys = _scattered(h, len(words))
                at = np.argpartition(keys, WORDS)[:WORDS] if len(keys) > WORDS else np.arange(len(keys))
                drawn += [(int(keys[i]), words[i]) for i in at[keys[at] < bound]]
                if len(drawn) > 2 * WORDS:
                    drawn = sorted(drawn)[:WORDS]
                    bound = drawn[-1][0]
            yield listed(out)
        drawn = sorted(drawn)[:WORDS]
        for i in range(0, len(drawn), 10_000):
            yield listed([(k, None, None, None, w) for k, w in drawn[i : i + 10_000]])

    return some.select("t", "h", "held").mapInArrow(run, "draw long, x binary, y int, held boolean, w string")


def _scattered(seed: int, n: int) -> np.ndarray:
    """``n`` numbers below 2^63 that look random and depend on the seed alone."""
    z = np.uint64(seed % (1 << 64)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(1)


def _encoded(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, LENGTH)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, x, y)`` of rows sorted by shard; one of far too many rows comes in several chunks."""
    shard, xs, ys = None, [], []
    for batch in batches:
        of, x, y = batch.column(0).to_numpy(), _encoded(batch.column(1)), batch.column(2).to_numpy()
        ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
        for s, e in zip([0, *ends], ends):
            if xs and (of[s] != shard or sum(map(len, xs)) >= 2 * CHUNK):
                yield shard, np.concatenate(xs), np.concatenate(ys)
                xs, ys = [], []
            shard = int(of[s])
            xs.append(x[s:e])
            ys.append(y[s:e])
    if xs:
        yield shard, np.concatenate(xs), np.concatenate(ys)


def _fit(rows: DataFrame, n_none: int, n_found: int, x: np.ndarray, y: np.ndarray) -> Network:
    """A network fitted on all ``rows`` (``n_found`` of label 1, ``n_none`` of 0) and the built findings ``x``, ``y``.

    Rows are dealt to shards by hash.  In each round every shard goes once through
    its rows and the built findings, beginning with the same network, and the mean of what
    the shards come to begins the next round.  Of either label, all rows of a shard
    together weigh no more than the built findings, or ordinary candidates would drown them.
    """
    net = Network()
    if not n_none + n_found:
        return net.fit(x, y)
    shards = -(-(n_none + n_found) // CHUNK)
    weights = np.array([WEAK * min(1.0, (y == 0).sum() * shards / max(1, n_none)), min(1.0, (y == 1).sum() * shards / max(1, n_found))])
    dealt = rows.select(F.pmod("draw", F.lit(shards)).alias("shard"), "x", "y", "draw").repartition(min(4 * shards, FILES), "shard")
    dealt = cut(dealt.sortWithinPartitions("shard", "draw", "x", "y").select("shard", "x", "y"), "dealt")
    rounds = EPOCHS if shards > 1 else 1

    def one_round(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, state = 0, 0.0
            for shard, own, found in _chunks(batches):
                local, both = copy.deepcopy(net), np.concatenate([y, found])
                local.fit(np.concatenate([x, own]), both, np.concatenate([np.ones(len(y)), weights[found]]), EPOCHS // rounds, seed=(4, number, shard))
                n, state = n + len(own), state + len(own) * local.state()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([state], pa.list_(pa.float64()))], names=["n", "state"])

        return run

    for number in range(rounds):
        parts = dealt.mapInArrow(one_round(number), "n long, state array<double>").collect()
        net.restore(sum(np.array(r["state"]) for r in parts) / sum(r["n"] for r in parts))
    return net


def smallest(values: DataFrame, k: int, few: int = 10_000) -> int:
    """The ``k``-th smallest, from 0, of a column of longs of at least 0: by counts of their leading bits, then of the next 16, until ``few`` are left."""
    for shift in (48, 32, 16, 0):
        lead = F.shiftright(values.columns[0], shift)
        for r in sorted(values.groupBy(lead.alias("lead")).count().collect()):
            if k < r["count"]:
                break
            k -= r["count"]
        values = values.where(lead == r["lead"])
        if r["count"] <= few:
            return sorted(v for (v,) in values.collect())[k]
    return r["lead"]


def drawn_words(rows: DataFrame) -> list[str]:
    """The distinct words among the ``WORDS`` drawn first of all tasks' words."""
    words = rows.where("w is not null")
    if words.count() > WORDS:
        words = words.where(F.col("draw") <= smallest(words.select("draw"), WORDS - 1))
    return sorted(w for (w,) in words.select("w").distinct().collect()) or ["data"]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> Network:
    """Fit on built findings and on all of the corpus's own; seeded, so repeatable.

    An empty table, or one without findings, leaves the built ones.
    """
    session_settings(docs.sparkSession)
    rows = cut(findings(docs, id_col, text_col), "findings")
    own = rows.where("w is null")
    n = {(r["held"], r["y"]): r["count"] for r in own.groupBy("held", "y").count().collect()}
    words = drawn_words(rows)
    built = [(encode(t, s, e), y) for t, s, e, y in labelled_findings(BUILT, words)]
    x, y = np.stack([a for a, _ in built]).astype(np.uint8), np.array([b for _, b in built], float)
    held = np.arange(len(x)) % 4 == 3
    net = _fit(own.where("not held"), n.get((False, 0), 0), n.get((False, 1), 0), x[~held], y[~held])
    # ordinary candidates of the corpus outnumber secrets: calibrate on the built ones, balanced
    unseen = [np.stack([encode(t, s, e) for t, s, e, label in labelled_findings(BUILT_UNSEEN, words, 12, {name: form}) if label]) for name, form in UNSEEN.items()]
    net.calibrate(x[held], y[held], recall, *unseen)
    if n.get((True, 1)):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # doubles of at least 0 are in the order of their bits
                yield pa.RecordBatch.from_arrays([pa.array(net.probability(_encoded(batch.column(0))).view(np.int64))], names=["p"])

        scored = cut(own.where("held and y = 1").select("x").mapInArrow(run, "p long"), "scored")
        least = np.int64(smallest(scored, int((1 - recall) * n[True, 1]))).view(np.float64)
        net.threshold = min(net.threshold, float(least))
    return net


def scan(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    """All findings of each text, by start, then kind; candidates of all texts are scored together."""
    found, more = [], []
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        more += [(i, s, e) for s, e in candidates(text or "", base)]
        found.append(base)
    for (i, s, e), ok in zip(more, net.accepts(texts, more), strict=True):
        if ok:
            found[i].append((s, e, 3))
    return [sorted(spans, key=lambda s: (s[0], s[2], s[1])) for spans in found]


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_model)``, one row per row of ``docs``.

    Null and empty texts have no findings.  Offsets are code points, ends
    exclusive, of the whole match, in texts of any length.  Repeated rows and null ids
    keep a row each.  Other columns are ignored, whatever their names.
    """
    session_settings(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [], [], []
            for spans in scan(batch.column(1).to_pylist(), net):
                counts.append([sum(k == i for *_, k in spans) for i in range(4)])
                digests.append(hashlib.sha256(_listed([s for s in spans if s[2] < 3]).encode()).hexdigest())
                listed.append(_listed(spans))
            c = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(c[:, 3])],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def redact(docs: DataFrame, net: Network, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every finding replaced by ``mask``; overlapping findings by one.

    For an assignment only what follows the separator is hidden. Texts without
    findings, and all other columns, stay as they were.
    """
    session_settings(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        out, done = [], 0
        for s, e, k in spans:
            if k == 0:
                s = ASSIGN.match(text, s).start(2)
            if e <= done:
                continue
            if s >= done:
                out += [text[done:s], mask]
            done = e
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).to_pylist()
            texts = pa.array([clean(t, spans) for t, spans in zip(raw, scan(raw, net), strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
