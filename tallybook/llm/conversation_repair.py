"""Repair of conversation structure at the least cost.

Every row of a conversation becomes one symbol, its role and its fault, so that a conversation is a short signature.
The suffixes of all distinct signatures form one automaton: signatures are sorted from their ends, and equal ends
share their nodes. For every node and grammar state the cost to go and the first of the cheapest edits are
computed once, from the node after it; a conversation's edits are then read along its own path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tallybook.operators.recommend import spread_join
from tallybook.sources.staging import stage

BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
NEVER = 1 << 40

# states of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {state: KEPT[role][state] for state, role in WANTED.items()}
ROLE = {"u": "user", "a": "assistant"}


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the damage that crc32 of `conv_id:turn` calls for; null role and text are a space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes its role user.
    """
    kind = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn"))).cast("binary")) % 20
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    return (
        conversations.select(
            "conv_id", "turn", _text(F.col("role")).alias("r"), _text(F.col("text")).alias("t"), kind.alias("d")
        )
        .filter("d != 0")
        .select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("r")).alias("role"), text.alias("text"), "d")
        .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1))))
        .drop("col")
    )


def _ordered(conversations: DataFrame) -> DataFrame:
    """Only the columns in use. Rows of one turn are ordered by role and by the digest of their text."""
    text = _text(conversations["text"])
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _text(conversations["role"]).alias("role"), text.alias("text"),
        F.md5(text.cast("binary")).alias("digest"),
    )


# ascending, so null turns come first
ORDER = ["conv_id", "turn", "role", "digest"]


def signatures(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, signature, gaps, blank, duplicate, truncated, illegal.

    A symbol of the signature is the first letter of the role (s, u, a, and o for any other), a capital where the text
    is cut off, and x where the row must go because its text is blank or was there before. A row's first fault counts.
    Texts stay where they are: only their digests are shuffled.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    narrow = _ordered(conversations).select(
        "conv_id", "turn", "role", "digest",
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(*STOPS)).alias("cut"),
    )
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    initial = F.substring("role", 1, 1)
    marked = (
        narrow.repartition("conv_id")
        .withColumn("before", F.row_number().over(seen) > 1)
        .sortWithinPartitions(*ORDER)
        .select(
            "conv_id", "turn",
            F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role"),
            F.when(F.col("blank"), "b").when(F.col("before"), "d").when(F.col("cut"), "t").otherwise("").alias("fault"),
        )
    )
    schema = _with_id(
        conversations, "signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
    )
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a conversation follow one another; of each, only its symbol is kept
        rows: list[tuple] = []
        now, turns, roles, faults = None, [], [], []

        def close() -> tuple:
            symbols = "".join(
                "x" if f in "bd" and f else r.upper() if f else r for r, f in zip(roles, faults, strict=True)
            )
            illegal = sum(1 for a, b in zip(roles, roles[1:], strict=False) if a + b not in ("su", "ua", "au"))
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return (now[0], symbols, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal)

        for batch in batches:
            for conv_id, turn, role, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        rows.append(close())
                    now, turns, roles, faults = (conv_id,), [], [], []
                if turn is not None:
                    # first, last and number of distinct turns so far
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
                roles.append(role), faults.append(fault)
            if len(rows) >= 4096:
                yield _batch(rows, out)
                rows = []
        if now is not None:
            rows.append(close())
        if rows:
            yield _batch(rows, out)

    return marked.mapInArrow(run, schema)


def _with_id(conversations: DataFrame, columns: str) -> StructType:
    return StructType([conversations.schema["conv_id"], *_parse_datatype_string(columns)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Suffixes:
    """The nodes on the path of one signature, from its end; the next signature in order keeps the ends they share."""

    # nothing is left to read: open exchanges are closed by insertions
    END = (0, 2 * INSERT, INSERT, 0)

    def __init__(self):
        self.path, self.nodes = "", [(0, self.END, "    ")]
        self.known: dict[tuple, tuple] = {}

    def _node(self, symbol: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
        """The least cost for all states, the costs of each above it, and the first edit of each."""
        options: list[dict[str, int]] = []
        must_go, late = symbol == "x", TRUNCATED if symbol.isupper() else 0
        role = symbol.lower()
        for state in range(4):
            edits = {"D": DELETE + after[state]}
            if not must_go:
                if state in KEPT.get(role, ()):
                    edits["K"] = late + after[KEPT[role][state]]
                if role != WANTED[state]:
                    edits["R"] = REROLE + late + after[AFTER[state]]
            options.append(edits)
        costs = [min(o.values()) for o in options]
        # two insertions in a row lead back to the same state
        without = list(costs)
        for state in range(4):
            options[state]["I"] = INSERT + without[AFTER[state]]
            costs[state] = min(options[state].values())
        for state in (START, SYSTEM):
            options[state]["I"] = INSERT + costs[AFTER[state]]
            costs[state] = min(options[state].values())
        least = min(costs)
        # all edits of a state begin with different letters, so the first letter settles a tie
        first = "".join(min(k for k, v in o.items() if v == c) for o, c in zip(options, costs, strict=True))
        return least, tuple(c - least for c in costs), first

    def solve(self, backwards: str) -> tuple[int, str]:
        """Cost and edits of a signature, given from its end to its start."""
        shared = 0
        for a, b in zip(self.path, backwards, strict=False):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in backwards[shared:]:
            base, after, _ = self.nodes[-1]
            found = self.known.get((symbol, after))
            if found is None:
                found = self.known[symbol, after] = self._node(symbol, after)
            self.nodes.append((base + found[0], found[1], found[2]))
        self.path = backwards
        edits, at, state = [], len(backwards), START
        while at:
            edit = self.nodes[at][2][state]
            edits.append(edit)
            if edit == "I":
                state = AFTER[state]
                continue
            if edit == "K":
                state = KEPT[backwards[at - 1].lower()][state]
            elif edit == "R":
                state = AFTER[state]
            at -= 1
        edits.append({SYSTEM: "II", USER: "I"}.get(state, ""))
        return self.nodes[-1][0] + self.nodes[-1][1][START], "".join(edits)


def solve(distinct: DataFrame) -> DataFrame:
    """signature, cost, audit for a table of distinct signatures.

    The tasks take ranges of the signatures read backwards, so that equal ends meet in one task; only the nodes at the
    edge of two ranges are computed twice.
    """
    schema = _parse_datatype_string("signature string, cost long, audit string")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Suffixes()
        for batch in batches:
            found = [(s[::-1], *automaton.solve(s)) for s in batch.column(0).to_pylist()]
            yield _batch(found, out)

    backwards = distinct.select(F.reverse("signature").alias("backwards"))
    return backwards.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(run, schema)


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conversation that has rows: the columns of `signatures`, and cost and audit of the cheapest repair.

    Each distinct signature is solved once. One signature may be that of very many conversations, so the join divides it.
    """
    found = stage(signatures(conversations).withColumn("key", F.md5("signature")))
    solved = stage(
        solve(found.select("signature").distinct()).select(F.md5("signature").alias("key"), "cost", "audit")
    )
    return spread_join(found, solved, "key").drop("key")


def repair(conversations: DataFrame, audited: DataFrame | None = None) -> DataFrame:
    """conv_id, place, role, text, edit: the rows of every repaired conversation, in order within a partition.

    A kept row has its role and text, a reroled one the role of its place, an inserted one an empty text. Null roles
    and texts are a space; rows of one turn go by role and digest, null turns first; null conv_ids are one
    conversation, and a role that is empty is as illegal as an unknown one. A conversation that the repair empties has
    no rows. Other columns are not read.
    """
    audited = stage(audits(conversations)) if audited is None else audited
    heads = audited.select(
        "conv_id", F.lit(0).alias("row"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"),
        F.lit("").alias("text"), F.lit("").alias("digest"),
    )
    rows = _ordered(conversations).select("conv_id", F.lit(1).alias("row"), "turn", "role", "text", "digest")
    both = (
        heads.unionByName(rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "row", *ORDER[1:])
        .select("conv_id", "row", "role", "text")
    )
    schema = _with_id(conversations, "place long, role string, text string, edit string")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, state = "", 0, 0, START

        def inserted(conv_id) -> Iterator[tuple]:
            nonlocal at, place, state
            while audit.startswith("I", at):
                yield conv_id, place, ROLE[WANTED[state]], "", "I"
                at, place, state = at + 1, place + 1, AFTER[state]

        for batch in batches:
            made: list[tuple] = []
            for conv_id, row, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not row:
                    audit, at, place, state = role, 0, 0, START
                else:
                    edit = audit[at]
                    at += 1
                    if edit == "R":
                        role, state = ROLE[WANTED[state]], AFTER[state]
                    elif edit == "K":
                        state = KEPT[role[0]][state]
                    if edit != "D":
                        made.append((conv_id, place, role, text, edit))
                        place += 1
                made.extend(inserted(conv_id))
            yield _batch(made, out)

    return both.mapInArrow(run, schema)


def _digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the sha256 of the lines `role:text`; rows of a conversation must follow one another."""
    schema = _with_id(repaired, "repaired_sha256 string")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv_id, place, role, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield _batch(done, out)
        if digest is not None:
            yield _batch([(now, digest.hexdigest())], out)

    return repaired.mapInArrow(run, schema)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the damaged table.

    Every conv_id of the table has a row; one that lost all its rows has zeros, no edits and the hash of nothing.
    """
    rows = damaged(conversations)
    audited = stage(audits(rows))
    hashes = stage(_digests(repair(rows, audited)))
    ids = conversations.select("conv_id").distinct()
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return (
        ids.join(audited.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
        .join(hashes.withColumnRenamed("conv_id", "h"), F.col("conv_id").eqNullSafe(F.col("h")), "left")
        .select(
            "conv_id",
            *[F.coalesce(f, F.lit(0).cast("long")).alias(f) for f in figures],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
        )
    )


def repair_digests_sql() -> str:
    """The same for DuckDB: crc32 bit by bit, and the repair from the last row on, one step for each row."""

    def fold(state: int) -> str:
        """Cost, edits and repaired lines from a row on, before insertions."""
        wanted = {START: ("u", "user", 3), SYSTEM: ("u", "user", 3), USER: ("a", "assistant", 4), ASSISTANT: ("u", "user", 3)}
        letter, name, to = wanted[state]
        after = "r.s[{}]"
        same = after.format(state + 1)
        kept = {START: "CASE m.i WHEN 's' THEN r.s[2] WHEN 'u' THEN r.s[3] END", SYSTEM: "CASE m.i WHEN 'u' THEN r.s[3] END",
                USER: "CASE m.i WHEN 'a' THEN r.s[4] END", ASSISTANT: "CASE m.i WHEN 'u' THEN r.s[3] END"}[state]
        rest = "CASE WHEN {0}.t = '' THEN '' ELSE chr(10) || {0}.t END"
        keep = f"{{'c': ({kept}).c + m.late, 'a': 'K' || ({kept}).a, 't': m.role || ':' || m.text || {rest.format(f'({kept})')}}}"
        into = after.format(to)
        rerole = f"{{'c': {into}.c + {REROLE} + m.late, 'a': 'R' || {into}.a, 't': '{name}:' || m.text || {rest.format(into)}}}"
        gone = f"{{'c': {same}.c + {DELETE}, 'a': 'D' || {same}.a, 't': {same}.t}}"
        return f"""list_sort(list_filter([{gone},
            CASE WHEN NOT m.gone AND ({kept}) IS NOT NULL THEN {keep} END,
            CASE WHEN NOT m.gone AND m.i != '{letter}' THEN {rerole} END], lambda x: x IS NOT NULL))[1]"""

    def insert(to: str, name: str) -> str:
        return f"""{{'c': {to}.c + {INSERT}, 'a': 'I' || {to}.a,
            't': '{name}:' || CASE WHEN {to}.t = '' THEN '' ELSE chr(10) || {to}.t END}}"""

    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    end = ", ".join(
        f"{{'c': {c}, 'a': '{a}', 't': {t}}}"
        for c, a, t in ((0, "", "''"), (2 * INSERT, "II", "'user:' || chr(10) || 'assistant:'"), (INSERT, "I", "'assistant:'"), (0, "", "''"))
    )
    return f"""
    WITH RECURSIVE given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    hashed AS (
        SELECT *, {crc32_sql('k')} % 20 AS d FROM given),
    rows_ AS (
        SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
               CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) FROM hashed WHERE d != 0)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS p,
               rtrim(text, {blanks}) AS x, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS i
        FROM rows_),
    marked AS (
        SELECT *, CASE WHEN x = '' THEN 'b'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
                       WHEN x[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
               i || coalesce(lead(i) OVER (PARTITION BY conv_id ORDER BY p), '') AS pair
        FROM placed),
    m AS (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END AS late FROM marked),
    figures AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
               count(*) FILTER (fault = 't') AS truncated,
               count(*) FILTER (length(pair) = 2 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n
        FROM m GROUP BY conv_id),
    r AS (
        SELECT conv_id, n AS p, [{end}] AS s FROM figures
        UNION ALL
        SELECT conv_id, p - 1, [list_sort([w[1], {insert('after_u', 'user')}])[1],
               list_sort([w[2], {insert('after_u', 'user')}])[1], after_u, after_a]
        FROM (SELECT conv_id, p, w, list_sort([w[3], {insert('w[4]', 'assistant')}])[1] AS after_u,
                     list_sort([w[4], {insert('w[3]', 'user')}])[1] AS after_a
              FROM (SELECT r.conv_id, r.p, [{', '.join(map(fold, range(4)))}] AS w
                    FROM r JOIN m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.p = r.p)))
    SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(r.s[1].c, 0)::BIGINT AS cost, coalesce(r.s[1].a, '') AS audit,
           sha256(coalesce(r.s[1].t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS i
    LEFT JOIN figures AS f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
    LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id AND r.p = 0"""


def crc32_sql(text: str) -> str:
    """DuckDB's unsigned crc32 of the UTF-8 of a text: for each byte, one step that mixes it in and eight that shift."""
    steps = f"""list_prepend(4294967295::BIGINT, flatten(list_transform(range(octet_length(encode({text}))),
        lambda i: [('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"""
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce({steps}, lambda c, b: CASE WHEN b < 0 THEN {shift} ELSE xor(c, b) END), 4294967295)"
