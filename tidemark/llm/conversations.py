"""op11: repair of conversation structure by rank-convergence parallel Viterbi.

A conversation's rows, in order of turn, are edited so that the role initials read
``(s?(ua)+)?``, at the least cost; of the cheapest edit sequences the least in ASCII wins.
The dynamic program runs backward over four states (what has been written so far is empty,
ends in s, in u, in a). Its cost vectors matter up to a constant only.

A conversation can hold any share of all rows, so it is cut into chunks. All chunks start at
once from a speculative vector, that of a conversation's end; a fix-up pass gives each chunk
the vector of the chunk behind it and reruns those for which the two differ by more than a
constant, until none does. A chunk then says for each entry state in which state it is left;
these maps are composed along the conversation, and every chunk traces its least audit from
its own entry state by the stitched backward costs.

Rows are sorted by ranges of (conversation, turn, role, text digest), never gathered by
conversation; one byte a row takes part in fix-up passes, and texts move once for the sort and,
only where a conversation crosses a chunk's edge, once more for its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, staged, table
from tidemark.llm.importance import CRC_TABLE, crc_sql

#: Rows of a chunk, and characters after which it ends early.
CHUNK_ROWS = 4096
CHUNK_CHARS = 2_000_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Costs behind a conversation's last row: user wants an assistant, system wants both.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Where s, u and a lead from each state, as far as they may follow.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one role of user and assistant that may follow each state.
WANTED = ("user", "user", "assistant", "user")

SOUND, CUT_OFF, FORCED = range(3)
_INITIALS = "sua"

_BACK: dict[tuple, tuple] = {}
_MOVES: dict[tuple, tuple] = {}


def row_code(initial: str, fault: int) -> int:
    """A row as the program sees it: which initial it has, and whether it is sound, truncated or to be deleted."""
    return (_INITIALS.find(initial) if len(initial) == 1 else -1) % 4 * 3 + fault


def _edges(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row."""
    yield "D", DELETE, state
    fault, initial = code % 3, "sua."[code // 3]
    if fault != FORCED:
        more = TRUNCATED if fault == CUT_OFF else 0
        if initial in NEXT[state]:
            yield "K", KEEP + more, NEXT[state][initial]
        yield "R", REROLE + more, NEXT[state][WANTED[state][0]]


def back(vector: tuple, code: int) -> tuple[tuple, int]:
    """Costs before a row from those behind it, less their minimum, and that minimum."""
    got = _BACK.get((vector, code))
    if got is None:
        costs = [min(cost + vector[to] for _, cost, to in _edges(code, state)) for state in range(4)]
        for _ in range(2):
            costs = [min(c, INSERT + costs[NEXT[s][WANTED[s][0]]]) for s, c in enumerate(costs)]
        least = min(costs)
        got = _BACK[vector, code] = tuple(c - least for c in costs), least
    return got


def moves(vector: tuple, code: int, state: int) -> tuple[tuple, int, int]:
    """The least edits by letter that keep to the backward costs, up to the one that uses up the row.

    Gives ((letter, role written), ...), the state behind the row and the cost.
    """
    got = _MOVES.get((vector, code, state))
    if got is None:
        before, least = back(vector, code)
        edits, spent, at = [], 0, state
        while True:
            rest = before[at] + least
            options = [(letter, cost, to, vector[to]) for letter, cost, to in _edges(code, at)]
            to = NEXT[at][WANTED[at][0]]
            options.append(("I", INSERT, to, before[to] + least))
            letter, cost, to, _ = min((o for o in options if o[1] + o[3] == rest), key=lambda o: o[0])
            edits.append((letter, WANTED[at] if letter in "IR" else None))
            spent, at = spent + cost, to
            if letter != "I":
                break
        got = _MOVES[vector, code, state] = tuple(edits), at, spent
    return got


def backward(codes: bytes, behind: tuple) -> list[tuple]:
    """Cost vectors, up to constants, before each row of a chunk and behind its last."""
    vectors = [behind]
    for code in reversed(codes):
        vectors.append(back(vectors[-1], code)[0])
    return vectors[::-1]


def trace(codes: bytes, behind: tuple, state: int, last: bool) -> tuple[list, int, int]:
    """(row or None, letter, role written) of each edit from an entry state; the state at the end; the cost."""
    vectors, edits, cost = backward(codes, behind), [], 0
    for k, code in enumerate(codes):
        step, state, spent = moves(vectors[k + 1], code, state)
        edits.extend((k if letter != "I" else None, letter, role) for letter, role in step)
        cost += spent
    while last and AT_END[state]:
        edits.append((None, "I", WANTED[state]))
        state, cost = NEXT[state][WANTED[state][0]], cost + INSERT
    return edits, state, cost


# Rows in order, and chunks of them.

_BLANKS = r"\x20\x09-\x0D"


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by conversation, turn (nulls first), role and text digest, in ranges; nulls are one space.

    ``copies`` says how often a row stands there. Ranges may end inside a conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    tail = F.expr("right(rtrim(concat(' ', char(9), char(10), char(11), char(12), char(13)), text), 1)")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.col("copies").cast("int").alias("copies"))
    rows = rows.withColumns({"same": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "tail": tail})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "same"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _chunk_type(conv: T.DataType) -> T.StructType:
    many = [T.StructField(n, T.ArrayType(t)) for n, t in (("same", T.BinaryType()), ("roles", T.StringType()), ("texts", T.StringType()))]
    return T.StructType([T.StructField("conv_id", conv), T.StructField("whole", T.BooleanType()), T.StructField("faults", T.BinaryType()), *many])


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows cut into chunks of one conversation each: conv_id, chunk, whole, faults, same, roles, texts.

    ``faults`` has a byte a row: blank, truncated or sound by the row itself, and duplicate as
    far as the chunk shows. ``whole`` chunks hold all of their conversation: another one stands
    before and behind them in the range. ``chunk`` orders the chunks of a conversation.
    """
    ordered = in_order(rows)
    small_batches(rows.sparkSession)
    kind = _chunk_type(ordered.schema["conv_id"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        done: list[tuple] = []
        conv, parts, first, chars, seen = None, 0, True, 0, set()
        faults, same, roles, texts = bytearray(), [], [], []

        def end(whole: bool) -> None:
            nonlocal faults, same, roles, texts, chars
            if faults:
                done.append((conv, whole and parts == 0, bytes(faults), same, roles, texts))
            faults, same, roles, texts, chars = bytearray(), [], [], [], 0

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(schema)], schema=schema)
            done.clear()
            return batch

        waiting, started = 0, False
        for batch in batches:
            for c, _, role, text, copies, digest, tail in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if started and c != conv:
                    end(not first)
                    parts, first, seen = 0, False, set()
                conv, started = c, True
                for _ in range(copies):
                    if len(faults) >= chunk_rows or chars >= CHUNK_CHARS:
                        end(False)
                        parts, seen = parts + 1, set()
                    blank = not tail
                    faults.append(3 if blank else 2 if digest in seen else 1 if tail not in ".!?" else 0)
                    if not blank:
                        seen.add(digest)
                    same.append(digest)
                    roles.append(role)
                    texts.append(text)
                    chars += len(text)
                waiting += len(text)
                if waiting >= CHUNK_CHARS and done:
                    yield emit()
                    waiting = 0
        end(False)
        if done:
            yield emit()

    return ordered.mapInArrow(cut, kind).withColumn("chunk", F.monotonically_increasing_id())


#: Fault bytes of ``chunks``.
OK_ROW, TRUNCATED_ROW, DUPLICATE_ROW, BLANK_ROW = range(4)


def _codes(faults: bytes, roles: list[str]) -> bytes:
    return bytes(row_code(r[:1], FORCED if f >= DUPLICATE_ROW else f) for f, r in zip(faults, roles, strict=True))


@F.udf(T.BinaryType())
def _with_duplicates(faults, more):
    """Fault bytes with the rows at ``more`` marked as duplicates, unless they are blank."""
    faults = bytearray(faults)
    for k in more or ():
        if faults[k] != BLANK_ROW:
            faults[k] = DUPLICATE_ROW
    return bytes(faults)


@F.udf(T.BinaryType())
def _program(faults, roles):
    return _codes(faults, roles)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _vector_before(codes: pd.Series, behind: pd.Series) -> pd.Series:
    return pd.Series([list(backward(c, tuple(int(x) for x in v))[0]) for c, v in zip(codes, behind, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _exits(codes: pd.Series, behind: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([[trace(c, tuple(int(x) for x in v), s, e)[1] for s in range(4)] for c, v, e in zip(codes, behind, last, strict=True)])


def with_later_duplicates(pieces: DataFrame) -> DataFrame:
    """Chunks of conversations that have several, with rows marked whose equal stands in an earlier chunk."""
    each = pieces.select("conv_id", "chunk", F.posexplode("same").alias("at", "digest"))
    firsts = each.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("text_digest")).agg(F.min("chunk").alias("first_chunk"))
    later = each.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_digest")) & (F.col("chunk") > F.col("first_chunk")))
    later = later.groupBy(F.col("chunk").alias("in_chunk")).agg(F.collect_list("at").alias("more"))  # at most a chunk's rows
    marked = pieces.join(later, pieces["chunk"] == later["in_chunk"], "left")
    return marked.withColumn("faults", _with_duplicates("faults", "more")).drop("in_chunk", "more")


#: How many times as many neighbouring chunks a pass runs through in one go than the pass before.
WIDER = 32


def converged(programs: DataFrame) -> DataFrame:
    """(chunk, behind, last): each chunk's true cost vector behind its rows, up to a constant.

    ``programs`` has conv_id, chunk and codes. A pass reruns the chunks whose vector was wrong,
    and no others. Chunks of most conversations forget what was behind them, so one pass is the
    rule; where vectors pass through unchanged (rows that all must go, say) a pass hands them on
    along runs of chunks, ``WIDER`` times as long in each pass, a chunk in memory at a time. So
    passes grow with the logarithm of a conversation's chunks.
    """
    along = Window.partitionBy("conv_id").orderBy("chunk")
    at_end = F.array(*map(F.lit, AT_END))
    start = programs.select("conv_id", "chunk", (F.row_number().over(along) - 1).alias("number"), F.lead("chunk").over(along).isNull().alias("last"), at_end.alias("behind"))
    first = start.join(programs.select(F.col("chunk").alias("of"), "codes"), F.col("chunk") == F.col("of")).withColumn("before", _vector_before("codes", "behind"))
    vectors, width = staged(first.select(*_VECTOR), "viterbi"), 1
    while True:
        led = vectors.withColumns({"actual": F.coalesce(F.lead("before").over(along), at_end), "run": F.floor(F.col("number") / width)})
        wrong = staged(led.where("actual <> behind").select(F.col("conv_id").alias("c"), F.col("run").alias("r")).distinct(), "viterbi-wrong")
        if wrong.isEmpty():
            return vectors.select("chunk", "behind", "last")
        touched = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))
        again = _rerun(led.join(wrong, touched, "left_semi"), programs)
        vectors = staged(led.join(wrong, touched, "left_anti").select(*_VECTOR).unionByName(again), "viterbi")
        width *= WIDER


_VECTOR = ("conv_id", "chunk", "number", "last", "behind", "before")


def _rerun(runs: DataFrame, programs: DataFrame) -> DataFrame:
    """Vectors of whole runs of chunks from what is behind each run; a chunk that had the right one keeps its own."""
    small_batches(runs.sparkSession)
    joined = runs.join(programs.select(F.col("chunk").alias("of"), "codes"), F.col("chunk") == F.col("of"))
    kind = T.StructType([runs.schema[c] for c in _VECTOR])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, run, vector = to_arrow_schema(kind), None, None
        for batch in batches:
            done = []
            for conv, chunk, number, last, behind, before, actual, at, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, at) != run:
                    run, vector = (conv, at), tuple(actual)
                if vector != tuple(behind):
                    behind, before = list(vector), list(backward(codes, vector)[0])
                done.append((conv, chunk, number, last, behind, before))
                vector = tuple(before)
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(schema)], schema=schema)

    ordered = joined.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", F.desc("chunk"))
    return ordered.select(*_VECTOR, "actual", "run", "codes").mapInArrow(go, kind)


def entries(programs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(of, behind, last, entry): the state in which the least audit enters each chunk.

    Maps of four states stream along each conversation, four small numbers a chunk.
    """
    maps = programs.join(vectors, "chunk").select("conv_id", "chunk", "last", "behind", _exits("codes", "behind", "last").alias("exits"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), EMPTY
        for batch in batches:
            entry = []
            for c, out in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                conv, state = (c, state) if c == conv else (c, EMPTY)
                entry.append(state)
                state = out[state]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(entry, pa.int32())], ["of", "entry"])

    ordered = maps.select("conv_id", "chunk", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.mapInArrow(compose, "of long, entry int").join(vectors.select(F.col("chunk").alias("of"), "behind", "last"), "of")


_TRACED = "chunk long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, first_initial string, last_initial string, lines array<string>"


def traced(pieces: DataFrame) -> DataFrame:
    """Each chunk's edits: counts of faults, the audit's letters, and the repaired ``role:text`` lines.

    ``pieces`` are chunks with behind, last and entry.
    """
    small_batches(pieces.sparkSession)
    conv = pieces.schema["conv_id"].dataType
    kind = T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(_TRACED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            done = []
            for conv_id, chunk, faults, roles, texts, behind, last, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edits, _, cost = trace(_codes(faults, roles), tuple(behind), entry, last)
                lines = [f"{role or roles[k]}:{texts[k] if k is not None else ''}" for k, letter, role in edits if letter != "D"]
                first = [r[:1] for r in roles]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
                counts = (faults.count(BLANK_ROW), faults.count(DUPLICATE_ROW), faults.count(TRUNCATED_ROW))
                done.append((conv_id, chunk, *counts, illegal, cost, "".join(letter for _, letter, _ in edits), first[0], first[-1], lines))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)] if done else [pa.array([], f.type) for f in schema], schema=schema)

    return pieces.select("conv_id", "chunk", "faults", "roles", "texts", "behind", "last", "entry").mapInArrow(run, kind)


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations as traced chunks: those of conversations with one chunk, and all others.

    ``rows`` has conv_id, turn, role, text and copies. Lines of a conversation are those of its
    chunks in order of ``chunk``.
    """
    pieces = staged(chunks(rows, chunk_rows), "conversation-chunks")
    one = pieces.where("whole").withColumns({"behind": F.array(*map(F.lit, AT_END)), "last": F.lit(True), "entry": F.lit(EMPTY)})
    several = pieces.where("not whole")
    several = staged(with_later_duplicates(several).withColumn("codes", _program("faults", "roles")).drop("same"), "conversation-parts")
    programs = several.select("conv_id", "chunk", "codes")
    at = entries(programs, converged(programs))
    return traced(one), traced(several.join(at, several["chunk"] == at["of"]))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def summaries(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation with rows.

    Nulls in role or text are one space, rows with a null conversation are one conversation,
    null turns come first, and rows of one turn stand by role and text digest. SHA-256 reads a
    conversation from its start to its end: the lines of one that crosses a chunk's edge stream
    through one task in order, without being gathered.
    """
    one, several = repaired(rows, chunk_rows)
    whole = one.select("conv_id", *_COUNTS, "audit", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    kind = T.StructType([one.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, state, done = to_arrow_schema(kind), None, []

        def close() -> None:
            if state:
                done.append((state["conv"], *state["counts"], "".join(state["audit"]), state["hash"].hexdigest()))

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != state["conv"]:
                    close()
                    state = {"conv": row["conv_id"], "counts": [0] * 5, "audit": [], "hash": hashlib.sha256(), "begun": False, "initial": None}
                for k, c in enumerate(_COUNTS):
                    state["counts"][k] += row[c]
                if state["initial"] is not None and state["initial"] + row["first_initial"] not in ("su", "ua", "au"):
                    state["counts"][3] += 1
                state["initial"] = row["last_initial"]
                state["audit"].append(row["audit"])
                for line in row["lines"]:
                    state["hash"].update(("\n" + line if state["begun"] else line).encode())
                    state["begun"] = True
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    ordered = several.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return whole.unionByName(ordered.mapInArrow(join, kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn: one in twenty each dropped, emptied, robbed of its full stops, repeated, given to the user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("copies"))


def turn_gaps(rows: DataFrame) -> DataFrame:
    """Turns missing between a conversation's first and last; null turns don't count."""
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct().groupBy("conv_id")
    return turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def repair_report(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for every conversation of the undamaged rows; those that lost all rows have zeros.

    Columns beside conv_id, turn, role and text are not read. An empty table gives no row.
    """
    rows = damaged(conversations)
    all_ids = conversations.select("conv_id").distinct()
    gaps, found = turn_gaps(rows).withColumnRenamed("conv_id", "g"), summaries(rows, chunk_rows).withColumnRenamed("conv_id", "f")
    joined = all_ids.join(gaps, F.col("conv_id").eqNullSafe(F.col("g")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("f")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS)]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql_edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    """A cheapest edit sequence (key: cost in six digits, then letters; r: lines written) with one more edit."""
    return f"case when {state} is not null then struct_pack(k := lpad(({state}.k[1:6]::int + {cost})::varchar, 6, '0') || {state}.k[7:] || '{letter}', r := {state}.r || {line}) end"


def _sql_inserts(source: str) -> str:
    """The four states' best sequences once inserts may follow."""
    user = ", ".join(_sql_edit(x, str(INSERT), "I", "'user:' || chr(10)") for x in ("e", "s", "a"))
    assistant = _sql_edit("u", str(INSERT), "I", "'assistant:' || chr(10)")
    return f"select * replace (list_min([a, {assistant}]) as a) from (select * replace (list_min([u, {user}]) as u) from {source})"


def _sql_row() -> str:
    """The four states' best sequences behind a row."""
    more = "case when fault = 'truncated' then 5 else 0 end"
    kept, may = "role || ':' || text || chr(10)", "fault not in ('blank', 'duplicate')"
    best = {}
    for to, came, initial in (("e", (), ""), ("s", ("e",), "s"), ("u", ("e", "s", "a"), "u"), ("a", ("u",), "a")):
        options = [_sql_edit(to, "2", "D")]
        options += [f"case when {may} and role[1] = '{initial}' then {_sql_edit(x, more, 'K', kept)} end" for x in came]
        written = "'user:'" if to == "u" else "'assistant:'"
        options += [f"case when {may} then {_sql_edit(x, '1 + ' + more, 'R', f'{written} || text || chr(10)')} end" for x in came if to in "ua"]
        best[to] = f"list_min([{', '.join(options)}]) as {to}"
    return ", ".join(best.values())


OP11_SQL = f"""
with recursive crc as (select {CRC_TABLE} as t),
src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place_key from conversations),
keys as (select place_key, {crc_sql("place_key", "t")} % 20 as damage from (select distinct place_key from src), crc),
damaged as (select conv_id, turn, case when damage = 4 then 'user' else role end as role,
  case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when damage = 3 then 2 else 1 end)) as copy
  from src join keys using (place_key) where damage <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || text), copy) as i from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) as nth, lag(role[1]) over (partition by conv_id order by i) as before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed from placed),
judged as (select *, case when trimmed = '' then 'blank' when nth > 1 then 'duplicate' when trimmed[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault from seen),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (i > 1 and before || role[1] not in ('su', 'ua', 'au')) as illegal, max(i) as n from judged group by 1),
steps as (
  select conv_id, n, 0::bigint as i, struct_pack(k := '000000', r := '') as e, null::struct(k varchar, r varchar) as s, null::struct(k varchar, r varchar) as u, null::struct(k varchar, r varchar) as a from counted
  union all
  select conv_id, n, i + 1 as i, {_sql_row()} from ({_sql_inserts("(select x.*, j.role, j.text, j.fault from steps x join judged j on j.conv_id is not distinct from x.conv_id and j.i = x.i + 1)")})
),
done as (select conv_id, list_min([e, a]) as best from ({_sql_inserts("(select * from steps where i = n)")})),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.k[1:6]::bigint, 0) as cost, coalesce(best.k[7:], '') as audit, sha256(coalesce(best.r[1:-2], '')) as repaired_sha256
from ids left join counted on counted.conv_id is not distinct from ids.conv_id left join done on done.conv_id is not distinct from ids.conv_id
"""
