"""Cheapest repair of conversations, by a scan over min-plus matrices.

A conversation should read ``(system? (user assistant)+)?``, an automaton of four states. Each turn is a 4x4
matrix: its cell (p, q) is the cheapest way to bring the automaton from p to q by editing that turn and inserting
turns behind it, as an element (cost, audit), where the audit is the initials of the edits. Elements are added
by joining them in order and chosen by the smaller cost, then the ASCII-least audit. Of two audits for the same turns
that cost the same, neither begins with the other (what follows could only be insertions, which cost), so the
choice survives joining and matrices multiply associatively. A conversation's repair is the product of its turns.

Rows are dealt to tasks by ranges of (conversation, turn) and sorted, so a long conversation lies in several
tasks. One that lies in a task whole is repaired there. What may go on in a neighbour, or is long, leaves the
task in chunks of bounded rows and bytes: first occurrences of turns are found by aggregation, each chunk's matrix
is a tree of products, and chunks are multiplied in a tree across chunks and partitions. The audit is then cut
at the chunks, and each chunk writes its part of the transcript.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, load, materialise, shuffle_width

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
ROLES = "sua"
#: Rows and characters of a chunk; a conversation beyond them leaves its task in chunks.
CHUNK, CHARS = 4096, 4 << 20
#: Chunks, or partitions, that are multiplied in a step of the tree; symbols that are multiplied one by one.
FAN, RUN = 16, 8
#: Short runs whose products a task keeps.
KNOWN = 1 << 14
#: Characters of a text that decide the order of rows of one turn and role before its hash does.
LEAD = 32
_STATES = range(4)  # nothing yet, after the system turn, after a user turn, after an assistant turn
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_LEGAL = {"su", "ua", "au"}


def _better(a: tuple | None, b: tuple | None):
    return b if a is None or (b is not None and b < a) else a


def multiply(a: list, b: list) -> list:
    """Product of matrices, which are lists of 16 elements or None where there is no way."""
    out = []
    for p in _STATES:
        ways = [(r, a[4 * p + r]) for r in _STATES if a[4 * p + r] is not None]
        for q in _STATES:
            best = None
            for r, x in ways:
                y = b[4 * r + q]
                if y is not None and (best is None or x[0] + y[0] <= best[0]):
                    best = _better(best, (x[0] + y[0], x[1] + y[1]))
            out.append(best)
    return out


def _cells(ways: dict) -> list:
    return [ways.get((p, q)) for p in _STATES for q in _STATES]


IDENTITY = _cells({(p, p): (0, "") for p in _STATES})
_ONE_INSERT = _cells({(p, q): (INSERT, "I") for (p, c), q in _NEXT.items() if c != "s"})
#: Any number of insertions; from no state do more than two help.
CLOSURE = [_better(_better(x, y), z) for x, y, z in zip(IDENTITY, _ONE_INSERT, multiply(_ONE_INSERT, _ONE_INSERT))]


def symbol(role: str, fault: int) -> str:
    """A turn as the matrix needs it: its role's initial, and whether it must go (1), is truncated (2) or neither (0)."""
    return "abcdefghijkl"[3 * (ROLES.find(role[:1]) if role[:1] else -1) + 3 + fault]


def initial(s: str) -> str:
    return "-sua"["abcdefghijkl".index(s) // 3]


def _turn_matrix(s: str) -> list:
    """Edits of a turn, then insertions."""
    fault, ways = "abcdefghijkl".index(s) % 3, {(p, p): (DELETE, "D") for p in _STATES}
    if fault != 1:
        extra = TRUNCATED if fault == 2 else 0
        for (p, c), q in _NEXT.items():
            if c == initial(s):
                ways[p, q] = _better(ways.get((p, q)), (KEEP + extra, "K"))
            if c != "s":
                ways[p, q] = _better(ways.get((p, q)), (REROLE + extra, "R"))
    return multiply(_cells(ways), CLOSURE)


TURNS = {s: _turn_matrix(s) for s in "abcdefghijkl"}


def product(symbols: str, known: dict | None = None) -> list:
    """Matrix of a sequence of turns, as a tree of products; ``known`` keeps those of short runs for other sequences."""
    if len(symbols) > RUN:
        half = RUN * ((len(symbols) // 2 + RUN - 1) // RUN)
        return multiply(product(symbols[:half], known), product(symbols[half:], known))
    out = None if known is None else known.get(symbols)
    if out is None:
        out = IDENTITY
        for s in symbols:
            out = multiply(out, TURNS[s])
        if known is not None:
            if len(known) >= KNOWN:
                known.clear()
            known[symbols] = out
    return out


def cheapest(matrix: list) -> tuple[int, str]:
    """Cost and audit of a conversation whose turns have this product."""
    whole = multiply(CLOSURE, matrix)
    return _better(whole[0], whole[3])


def illegal(symbols: str) -> int:
    roles = list(map(initial, symbols))
    return sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:]))


def transcript(rows, edits: str, state: int = 0) -> tuple[list[str], int]:
    """The lines ``role:text`` that the edits leave of (role, text) rows, and the state after them."""
    out, at = [], iter(rows)
    for e in edits:
        role, text = (None, "") if e == "I" else next(at)
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if state == 2 else "user"
        state = _NEXT[state, role[:1]]
        out.append(f"{role}:{text}")
    return out, state


def fault_of(text: str) -> int:
    """1 for blank, 2 for truncated, else 0."""
    bare = text.strip(SPACE)
    return 1 if not bare else 0 if bare[-1] in STOPS else 2


def key_of(role: str, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))


def _solved(rows: list, known: dict) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, transcript of a conversation's (turn, role, text) rows."""
    seen, symbols, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        fault, key = fault_of(text), key_of(role, text)
        kind = 0 if fault == 1 else 1 if key in seen else 2 if fault == 2 else None
        seen.add(key)
        if kind is not None:
            counts[kind] += 1
        symbols.append(symbol(role, 0 if kind is None else 2 if kind == 2 else 1))
    turns = {t for t, _, _ in rows if t is not None}
    symbols = "".join(symbols)
    cost, audit = cheapest(product(symbols, known))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *counts, illegal(symbols), cost, audit, "\n".join(transcript(((r, t) for _, r, t in rows), audit)[0])


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ROW = "p int, c int, i long, turn long, role string, text string, fault int, hi long, lo long"


def _scan_batches(first_is_whole=lambda p: p == 0):
    """Sorted rows of a task: a row with a report for each conversation that is whole in it; of others their chunks' rows.

    The first row of a chunked conversation in a task has i = -1 and stands for no turn.
    """
    names = ["conv_id", *[c.split()[0] for c in f"{_REPORT}, transcript string, {_ROW}".split(", ")]]
    types_ = {"audit": pa.string(), "transcript": pa.string(), "role": pa.string(), "text": pa.string(), "p": pa.int32(), "c": pa.int32(), "fault": pa.int32()}

    def run(batches):
        p, kind = TaskContext.get().partitionId(), None
        out, held, known = {n: [] for n in names}, 0, {}

        def emit(conv, report=(None,) * 8, row=(None,) * 9):
            nonlocal held
            for n, v in zip(names, (conv, *report, *row), strict=True):
                out[n].append(v)
            held += 200 + len(report[7] or "") + len(report[6] or "") + len(row[5] or "")

        def batch():
            nonlocal held
            arrays = [pa.array(out[n], kind if n == "conv_id" else types_.get(n, pa.int64())) for n in names]
            for n in names:
                out[n].clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names=names)

        conv, rows, chars, split, marked, c, i, began = None, [], 0, False, False, 0, 0, False  # i numbers all rows of the task

        def chunk():
            """The waiting rows as a chunk."""
            nonlocal rows, chars, split, marked, c, i
            if not marked:
                emit(conv, row=(p, 0, -1, None, None, None, None, None, None))
            split = marked = True
            for turn, role, text in rows:
                hi, lo = np.frombuffer(key_of(role, text), ">i8").tolist()
                emit(conv, row=(p, c, i, turn, role, text, fault_of(text), hi, lo))
                i += 1
            rows, chars, c = [], 0, c + 1

        for b in batches:
            kind = b.column("conv_id").type
            for k, turn, role, text, copies in zip(*[b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "copies")], strict=True):
                if not began or k != conv:
                    if began:
                        if split:
                            chunk()
                        else:
                            emit(conv, _solved(rows, known))
                    split = not began and not first_is_whole(p)
                    conv, rows, chars, marked, c, began = k, [], 0, False, 0, True
                for _ in range(copies):
                    rows.append((turn, role, text))
                    chars += len(text)
                    if len(rows) >= CHUNK or chars >= CHARS:
                        chunk()
                if held > 2 * CHARS:
                    yield batch()
        if began:
            chunk()
            yield batch()

    return run


def _matrix_batches(batches):
    """Chunks' symbols to matrices: 16 costs (null: no way) and audits, the outer initials, and illegal neighbours."""
    known: dict = {}
    for b in batches:
        costs, audits, ends, wrong = [], [], [], []
        for s in b.column("symbols").to_pylist():
            m = product(s, known)
            costs.append([None if x is None else x[0] for x in m])
            audits.append([None if x is None else x[1] for x in m])
            ends.append(initial(s[0]) + initial(s[-1]) if s else "")
            wrong.append(illegal(s))
        arrays = [*(b.column(x) for x in ("conv_id", "p", "c")), pa.array(ends, pa.string()), pa.array(wrong, pa.int64()), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "p", "c", "ends", "illegal", "costs", "audits"])


def _read_matrix(costs, audits) -> list:
    return [None if c is None or c != c else (int(c), a) for c, a in zip(costs, audits, strict=True)]


def _folded(part: pd.DataFrame) -> pd.DataFrame:
    """One row for at most FAN neighbouring rows of a conversation."""
    part = part.sort_values(["p", "c"])
    matrix, ends, wrong = IDENTITY, "", 0
    for e, w, costs, audits in zip(part["ends"], part["illegal"], part["costs"], part["audits"], strict=True):
        matrix = multiply(matrix, _read_matrix(costs, audits))
        wrong += w + (bool(ends and e) and ends[1] + e[0] not in _LEGAL)
        ends = (ends or e)[:1] + (e or ends)[1:]
    head = part.iloc[:1][["conv_id", "p", "c"]].reset_index(drop=True)
    head["ends"], head["illegal"] = ends, wrong
    head["costs"] = [[None if x is None else x[0] for x in matrix]]
    head["audits"] = [[None if x is None else x[1] for x in matrix]]
    return head


def _cheapest_batches(batches):
    for b in batches:
        found = [cheapest(_read_matrix(c, a)) for c, a in zip(b.column("costs").to_pylist(), b.column("audits").to_pylist(), strict=True)]
        arrays = [b.column("conv_id"), b.column("illegal"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "illegal", "cost", "audit"])


def _cut_audit(part: pd.DataFrame) -> pd.DataFrame:
    """The audit (in the row with p = -1) cut at the conversation's chunks, and the state before each.

    A chunk's edits are those of its turns and the insertions behind them; insertions ahead of all are the first's.
    """
    audit = part.loc[part["p"] < 0, "symbols"].iloc[0]
    rest = part[part["p"] >= 0].sort_values(["p", "c"])
    at, state, edits, states = 0, 0, [], []
    for s in rest["symbols"]:
        begin, todo = at, len(s)
        states.append(state)
        while at < len(audit) and (todo or audit[at] == "I"):
            todo -= audit[at] != "I"
            at += 1
        edits.append(audit[begin:at])
        state = transcript(((initial(x), "") for x in s), edits[-1], state)[1]
    return pd.DataFrame({"conv_id": rest["conv_id"].tolist(), "p": rest["p"].tolist(), "c": rest["c"].tolist(), "edits": edits, "state": states})


def _written_chunk(part: pd.DataFrame) -> pd.DataFrame:
    """A chunk's part of the transcript; its edits are in the row with i = -2, the state before it in that row's fault."""
    head = part[part["i"] == -2].iloc[0]
    rows = part[part["i"] >= 0].sort_values("i")
    lines, _ = transcript(zip(rows["role"], rows["text"], strict=True), head["text"], int(head["fault"]))
    out = pd.DataFrame({"conv_id": [head["conv_id"]], "p": [head["p"]], "c": [head["c"]], "transcript": ["\n".join(lines)]})
    return out if lines else out.iloc[:0]


class Repaired(NamedTuple):
    """``report``: a row per conversation, with its transcript where that is in one piece (else null, see ``parts``).

    ``parts``: conv_id, p, c, transcript of the other conversations; pieces in order of (p, c) are joined by line ends.
    """

    report: DataFrame
    parts: DataFrame


def repair(turns: DataFrame, copies: str | None = None) -> Repaired:
    """Reports ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, transcript``, and long transcripts.

    Input columns are ``conv_id, turn, role, text``; a null role or text is one space, a null turn sorts first, null
    conv_ids are one conversation. Rows of one turn go by role, the first characters of the text and its hash, so only equal rows
    tie. ``copies`` names a column with the number of times that a row stands there, once where it is null; a conversation all of whose rows
    stand there 0 times has a report too. Other columns are ignored; an empty table gives an empty result.
    """
    spark = turns.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    times = F.lit(1) if copies is None else F.coalesce(F.col(copies).cast("int"), F.lit(1))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), times.alias("copies"))
    order = ["conv_id", "turn", "role", "lead", "mark", "spread"]  # equal rows are spread over tasks too
    rows = rows.withColumns({"lead": F.substring("text", 1, LEAD), "mark": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    kind = turns.schema["conv_id"].dataType.simpleString()
    scanned = materialise(in_batches(dealt).mapInArrow(_scan_batches(), f"conv_id {kind}, {_REPORT}, transcript string, {_ROW}"), "conversations")
    whole = scanned.filter("p is null").select("conv_id", *[c.split()[0] for c in _REPORT.split(", ")], "transcript")
    open_ = scanned.filter("p is not null").select("conv_id", *[c.split()[0] for c in _ROW.split(", ")])

    # Chunks as symbols. The first row with a key is no duplicate; that is decided where keys are aggregated, and rows meet it by their own place.
    real = open_.filter("i >= 0")
    firsts = real.groupBy("conv_id", "hi", "lo").agg(F.min(F.struct("p", "i")).alias("at")).select(F.col("at.p").alias("p"), F.col("at.i").alias("i"), F.lit(True).alias("fresh"))
    turn_facts = real.select("conv_id", "turn", "p", "c", "i", "fault", F.instr(F.lit(ROLES), F.substring("role", 1, 1)).alias("place"), F.octet_length("role").alias("n"))
    marked = turn_facts.join(firsts, ["p", "i"], "left").withColumn("fresh", F.col("fresh").isNotNull())
    is_blank, again = F.col("fault") == 1, (F.col("fault") != 1) & ~F.col("fresh")
    cut_off = (F.col("fault") == 2) & F.col("fresh")
    number = 3 * F.when(F.col("n") > 0, F.col("place")).otherwise(0) + F.when(is_blank | again, 1).when(cut_off, 2).otherwise(0)
    sign = F.substr(F.lit("abcdefghijkl"), number + 1, F.lit(1))
    per_chunk = marked.groupBy("conv_id", "p", "c").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", sign.alias("s")))), lambda x: x["s"]), "").alias("symbols"),
        F.count_if(is_blank).alias("blank"), F.count_if(again).alias("duplicate"), F.count_if(cut_off).alias("truncated"),
    )
    zero = F.lit(0).cast("long")
    markers = open_.filter("i < 0").select("conv_id", "p", F.lit(-1).alias("c"), F.lit("").alias("symbols"), zero.alias("blank"), zero.alias("duplicate"), zero.alias("truncated"))
    chunks = materialise(per_chunk.unionByName(markers), "chunks")

    matrices = f"conv_id {kind}, p int, c int, ends string, illegal long, costs array<long>, audits array<string>"
    tree = in_batches(chunks.select("conv_id", "p", "c", "symbols")).mapInArrow(_matrix_batches, matrices)
    top = chunks.agg(F.max("p").alias("p"), F.max("c").alias("c")).first()
    step = FAN
    while top["c"] is not None and step < FAN * (top["c"] + 2):
        tree = tree.groupBy("conv_id", "p", F.floor((F.col("c") + 1) / step)).applyInPandas(_folded, matrices)
        step *= FAN
    step = FAN
    while top["p"] is not None and step < FAN * (top["p"] + 1):
        tree = tree.groupBy("conv_id", F.floor(F.col("p") / step)).applyInPandas(_folded, matrices)
        step *= FAN
    solved = materialise(in_batches(tree).mapInArrow(_cheapest_batches, f"conv_id {kind}, illegal long, cost long, audit string"), "solved")

    counted = chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]).withColumnRenamed("conv_id", "id")
    distinct = real.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    spans = distinct.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps")).withColumnRenamed("conv_id", "span_id")
    report = (
        solved.join(counted, F.col("conv_id").eqNullSafe(F.col("id"))).join(spans, F.col("conv_id").eqNullSafe(F.col("span_id")), "left")
        .select("conv_id", F.coalesce("gaps", zero).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.lit(None).cast("string").alias("transcript"))
    )

    edits = chunks.select("conv_id", "p", "c", "symbols").unionByName(solved.select("conv_id", F.lit(-1).alias("p"), F.lit(-1).alias("c"), F.col("audit").alias("symbols")))
    edits = edits.groupBy("conv_id").applyInPandas(_cut_audit, f"conv_id {kind}, p int, c int, edits string, state int")
    none = F.lit(None)
    heads = edits.select("conv_id", "p", "c", F.lit(-2).cast("long").alias("i"), none.cast("string").alias("role"), F.col("edits").alias("text"), F.col("state").alias("fault"))
    pieces = real.select("conv_id", "p", "c", "i", "role", "text", "fault").unionByName(heads)
    parts = pieces.groupBy("conv_id", "p", "c").applyInPandas(_written_chunk, f"conv_id {kind}, p int, c int, transcript string")
    return Repaired(whole.unionByName(report), parts)


def _hash_batches(batches):
    """SHA-256 of each conversation's pieces, which arrive in order, joined by line ends."""
    conv, h, began = None, None, False
    for b in batches:
        done = []
        for k, piece in zip(b.column("conv_id").to_pylist(), b.column("transcript"), strict=True):
            if not began or k != conv:
                if began:
                    done.append((conv, h.hexdigest()))
                conv, h, began = k, hashlib.sha256(), True
            else:
                h.update(b"\n")
            h.update(piece.as_py().encode("utf-8", "surrogatepass"))
        kind = b.column("conv_id").type
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())], names=["hash_id", "hash"])
    if began:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([h.hexdigest()], pa.string())], names=["hash_id", "hash"])


def with_hashes(found: Repaired) -> DataFrame:
    """The report with ``repaired_sha256`` in place of the transcript.

    A hash has no parts, so one task reads a long conversation's pieces, one at a time.
    """
    spark = found.report.sparkSession
    kind = found.report.schema["conv_id"].dataType.simpleString()
    sorted_ = found.parts.repartition(shuffle_width(spark), "conv_id").sortWithinPartitions("conv_id", "p", "c").select("conv_id", "transcript")
    hashes = in_batches(sorted_).mapInArrow(_hash_batches, f"hash_id {kind}, hash string")
    whole = found.report.filter("transcript is not null").withColumn("repaired_sha256", F.sha2("transcript", 256)).drop("transcript")
    long = found.report.filter("transcript is null").drop("transcript").join(hashes, F.col("conv_id").eqNullSafe(F.col("hash_id")), "left").drop("hash_id")
    return whole.unionByName(long.withColumn("hash", F.coalesce("hash", F.sha2(F.lit(""), 256))).withColumnRenamed("hash", "repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with the faults that the checksum of a row's name asks for; dropped rows have no copy."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(one("conv_id"), F.lit(":"), one("turn")), "UTF-8")) % 20
    text = F.when(code <= 1, "").when(code == 2, F.translate(one("text"), STOPS, "")).otherwise(one("text"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(code == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def op13_conversation_repair(spark, sf_dir):
    return with_hashes(repair(damage(load(spark, sf_dir, "conversations")), "copies"))


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"


def _cell(now: str, cost: str, letters: str) -> str:
    """A cell in SQL: ten digits of cost, then the audit; ``least`` picks the cheapest, then the least audit."""
    return f"(lpad(((left({now}, 10))::BIGINT + {cost})::VARCHAR, 10, '0') || substr({now}, 11) || '{letters}')"


def _sql() -> str:
    bare = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    zero = "'0000000000'"
    start = [zero, "NULL", _cell(zero, str(INSERT), "I"), _cell(zero, str(2 * INSERT), "II")]

    def edited(q: int) -> str:
        """Edits of the turn x that end in state q."""
        ways = [_cell(f"a.s{q}", str(DELETE), "D")]
        for (p, c), to in _NEXT.items():
            if to == q:
                ways.append(f"CASE WHEN x.fault <> 1 AND x.role = '{c}' THEN {_cell(f'a.s{p}', 'CASE WHEN x.fault = 2 THEN 5 ELSE 0 END', 'K')} END")
                if c != "s":
                    ways.append(f"CASE WHEN x.fault <> 1 THEN {_cell(f'a.s{p}', 'CASE WHEN x.fault = 2 THEN 6 ELSE 1 END', 'R')} END")
        return f"least({', '.join(ways)}, NULL)"

    def closed(q: int) -> str:
        """The same with up to two insertions behind the turn."""
        more = {2: [(0, 1), (1, 1), (3, 1)], 3: [(2, 1), (0, 2), (1, 2)]}.get(q, [])
        return f"least({', '.join([f'e{q}', *[_cell(f'e{r}', str(INSERT * n), 'I' * n) for r, n in more], 'NULL'])})"

    edits, states = ", ".join(f"{edited(q)} AS e{q}" for q in _STATES), ", ".join(f"{closed(q)} AS s{q}" for q in _STATES)
    return f"""
WITH RECURSIVE d0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations
),
t AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
d1 AS MATERIALIZED (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM d0, t
),
d2 AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '{STOPS}', '') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d1 WHERE code <> 0
),
d3 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, {LEAD}), text, copy) AS pos FROM d2),
d4 AS (SELECT *, {bare} AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM d3),
d5 AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN NOT contains('{STOPS}', right(bare, 1)) THEN 't' ELSE '' END AS kind FROM d4
),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate,
         count(*) FILTER (kind = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM d5 GROUP BY conv_id
),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, {", ".join(f"{c}::VARCHAR AS s{q}" for q, c in enumerate(start))} FROM (SELECT DISTINCT conv_id FROM d5)
  UNION ALL
  SELECT conv_id, pos, {states} FROM (
    SELECT a.conv_id, x.pos, {edits}
    FROM walk a JOIN (SELECT conv_id, pos, left(role, 1) AS role, CASE kind WHEN '' THEN 0 WHEN 't' THEN 2 ELSE 1 END AS fault FROM d5) x
      ON x.conv_id IS NOT DISTINCT FROM a.conv_id AND x.pos = a.pos + 1
  )
),
best AS (SELECT w.conv_id, least(s0, s3) AS b FROM walk w JOIN facts f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.n),
letters AS (
  SELECT conv_id, k, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS place
  FROM (SELECT conv_id, unnest(string_split(substr(b, 11), '')) AS e, unnest(range(1, length(b) - 9)) AS k FROM best WHERE length(b) > 10)
),
edited AS (
  SELECT l.*, d5.role, d5.text, max(CASE WHEN e = 'K' AND place = 1 AND left(d5.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN d5 ON e <> 'I' AND d5.conv_id IS NOT DISTINCT FROM l.conv_id AND d5.pos = l.pos
),
spoken AS (
  SELECT conv_id, string_agg(CASE e WHEN 'K' THEN role ELSE CASE WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said
  FROM edited WHERE e <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(left(b, 10)::BIGINT, 0) AS cost, coalesce(substr(b, 11), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN spoken ON spoken.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP13_SQL = _sql()
