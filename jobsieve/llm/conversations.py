r"""Conversation structure repair: cheapest edits that give the role initials of a conversation the form `(s?(ua)+)?`.

Rows stand in order of turn (NULL first), then of role and text. A row's first fault counts: blank (no character
outside white space), duplicate (role and text seen earlier), truncated (its last such character is none of `.!?`).
Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert an empty user or
assistant turn anywhere 3; truncated rows that stay add 3. Of the cheapest edits the ASCII-least row of initials wins.

The repair is parsed bottom-up by span length, as in CYK, with a grammar in Chomsky normal form: its nonterminals
[p q] say what stands before and behind a span (nothing, system, user, assistant), its rules are [p q] -> [p r] [r q].
A cell holds the least (cost, audit) of every nonterminal; cells are closed under insertions. Costs follow from the
letters of an audit and the rows, so of two audits of one cost none is a prefix of the other, and concatenation keeps
their order: least cells combine to least cells. Rows enter as symbols (initial, must go, truncated); whole rows of
symbols that came before are remembered.

Scale: rows are sorted by conversation and place, so a long conversation lies on many tasks. Each task parses its
stretch in pieces of PIECE rows and joins their cells; one slim row for each stretch of a conversation meets in a
task. Texts pass one row at a time through the digest of their conversation, which is sequential by nature.

Defined results: NULL conv_id, turn, role and text are read as one space where text is wanted (the NULL conversation is
a conversation of its own); repeated rows are rows (the later ones are duplicates); a role without an allowed initial
is kept by no edit; texts of any length; a conversation without rows has zeros, an empty audit and the digest of
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import saved, small_side

PIECE = 24              # rows that are parsed at once
KNOWN = 50_000          # rows of symbols that a task remembers
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# What stands before or behind a span.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTED = (NOTHING, ASSISTANT)
FOLLOWS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]
Symbol = tuple[str, bool, bool]     # initial, must go, truncated


def _better(cell: Cell, key: tuple[int, int], found: tuple[int, str]) -> None:
    if key not in cell or found < cell[key]:
        cell[key] = found


def joined(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """Cell of two neighbouring spans: rule [p q] -> [p r] [r q]."""
    out = {} if into is None else into
    by_start: dict[int, list] = {}
    for (r, q), found in right.items():
        by_start.setdefault(r, []).append((q, found))
    for (p, r), (cost, audit) in left.items():
        for q, (more, rest) in by_start.get(r, ()):
            if (p, q) not in out or cost + more <= out[p, q][0]:
                _better(out, (p, q), (cost + more, audit + rest))
    return out


def _insertions() -> Cell:
    """Cell of the empty span: any row of insertions."""
    out = {(s, s): (0, "") for s in range(4)}
    for _ in range(4):
        for (p, r), (cost, audit) in list(out.items()):
            for (before, initial), q in STEPS.items():
                if before == r and initial in ROLES:
                    _better(out, (p, q), (cost + INSERT, audit + "I"))
    return out


EMPTY = _insertions()


def symbol_cell(symbol: Symbol) -> Cell:
    """Cell of one row, closed under insertions before and behind it."""
    initial, gone, truncated = symbol
    out: Cell = {(s, s): (DELETE, "D") for s in range(4)}
    if not gone:
        extra = TRUNCATED if truncated else 0
        for (p, role), q in STEPS.items():
            if role == initial:
                _better(out, (p, q), (KEEP + extra, "K"))
            if role in ROLES:
                _better(out, (p, q), (REROLE + extra, "R"))
    return joined(joined(EMPTY, out), EMPTY)


def parsed(symbols: list[Symbol]) -> Cell:
    """Cell of a row of symbols, by all spans and splits in order of length."""
    n = len(symbols)
    if not n:
        return EMPTY
    cells = {(i, i + 1): symbol_cell(s) for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                joined(cells[i, k], cells[k, i + length], cell)
            cells[i, i + length] = cell
    return cells[0, n]


def result(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the whole conversation."""
    return min(cell[NOTHING, q] for q in ACCEPTED if (NOTHING, q) in cell)


class _Stretch:
    """Rows of one conversation in a task: the cell of those read, first and last initial, illegal neighbours."""

    def __init__(self, known: dict[tuple[Symbol, ...], Cell]):
        self.known, self.open, self.pieces = known, [], []
        self.first = self.last = None
        self.illegal = 0

    def add(self, symbol: Symbol) -> None:
        if self.last is None:
            self.first = symbol[0]
        else:
            self.illegal += self.last + symbol[0] not in FOLLOWS
        self.last = symbol[0]
        self.open.append(symbol)
        if len(self.open) == PIECE:
            self._close()

    def _close(self) -> None:
        key = tuple(self.open)
        if key not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[key] = parsed(self.open)
        # Cells of equal length are joined, like the digits of a binary counter.
        length, cell, self.open = 1, self.known[key], []
        while self.pieces and self.pieces[-1][0] == length:
            before = self.pieces.pop()
            length, cell = 2 * length, joined(before[1], cell)
        self.pieces.append((length, cell))

    def cell(self) -> Cell:
        if self.open:
            self._close()
        out = self.pieces[-1][1]
        for _, before in reversed(self.pieces[:-1]):
            out = joined(before, out)
        return out


def _or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


# What the damage does, by the remainder of a row's checksum.
DROP, EMPTY_TEXT, UNPUNCTUATE, REPEAT, TO_USER = range(5)


def damaged(df: DataFrame) -> DataFrame:
    """The rows with the damage that crc32(`conv_id:turn`) % 20 asks for; a repeated row stands on two rows."""
    what = F.crc32(F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn"))).cast("binary")) % 20
    text = _or_space(F.col("text"))
    text = F.when(what == EMPTY_TEXT, "").when(what == UNPUNCTUATE, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(what == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = df.where(what != DROP).select(
        "conv_id", "turn", F.when(what == TO_USER, "user").otherwise(_or_space(F.col("role"))).alias("role"),
        text.alias("text"), copies.alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place (`at`), role, text, and the faults; saved in order of conversation and place."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    bare = F.rtrim(F.translate("text", "\t\n\u000b\u000c\r", "     "))
    # The last sort key splits rows that are equal otherwise; which of them comes first makes no difference.
    ordered = (rows.withColumn("_no", F.monotonically_increasing_id())
               .orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "_no")
               .select("conv_id", "turn", F.monotonically_increasing_id().alias("at"), "role", "text",
                       (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
                       F.unhex(digest).alias("digest")))
    ordered = saved(ordered, "rows")
    conv = F.col("conv_id")
    seen = (ordered.where("not blank").groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
            .where("first < last").select(conv.alias("c"), F.col("digest").alias("d"), "first"))
    seen = small_side(saved(seen, "seen"))
    again = conv.eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("at") > F.col("first"))
    slim = ordered.join(seen, again, "left").select(
        "conv_id", "turn", "at", "role", "text", "blank", (~F.col("blank") & F.col("first").isNotNull()).alias("duplicate"),
        "open")
    return slim.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("duplicate")).drop("open")


_CELL = "array<struct<p:int,q:int,cost:bigint,audit:string>>"


def _stretches(rows: DataFrame) -> DataFrame:
    """One row for every conversation and task: conv_id, at, first and last initial, illegal, cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[Symbol, ...], Cell] = {}
        conv, at, stretch, out = None, None, None, []

        def close() -> None:
            if stretch is not None:
                cell = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in stretch.cell().items()]
                out.append((conv, at, stretch.first, stretch.last, stretch.illegal, cell))

        def batch_of() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
            out.clear()
            return batch

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field(0).type), ("at", pa.int64()), ("first", pa.string()),
                                    ("last", pa.string()), ("illegal", pa.int64()), ("cell", pa.list_(pa.struct(
                                        [("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
            for c, place, initial, gone, truncated in zip(*[x.to_pylist() for x in batch.columns]):
                if stretch is None or c != conv:
                    close()
                    conv, at, stretch = c, place, _Stretch(known)
                stretch.add((initial, gone, truncated))
            if out:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    kind = rows.schema["conv_id"].dataType.simpleString()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    symbols = rows.select("conv_id", "at", F.left("role", F.lit(1)).alias("initial"),
                          (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    return (symbols.repartitionByRange(tasks, F.asc_nulls_first("conv_id"), "at")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), "at")
            .mapInArrow(run, f"conv_id {kind}, at long, first string, last string, illegal long, cell {_CELL}"))


def _whole(stretches: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal: the stretches of every conversation joined in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conv, state, out = None, None, None, []

        def close() -> None:
            if state is not None:
                cost, audit = result(state[0])
                out.append({"conv_id": conv, "cost": cost, "audit": audit, "illegal": state[2]})

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("cost", pa.int64()),
                                          ("audit", pa.string()), ("illegal", pa.int64())])
            for row in batch.to_pylist():
                cell = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in row["cell"]}
                if state is None or row["conv_id"] != conv:
                    close()
                    conv, state = row["conv_id"], (cell, row["last"], row["illegal"])
                else:
                    crossing = state[1] + row["first"] not in FOLLOWS
                    state = joined(state[0], cell), row["last"], state[2] + row["illegal"] + crossing
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = stretches.schema["conv_id"].dataType.simpleString()
    return (stretches.repartition("conv_id").sortWithinPartitions("conv_id", "at")
            .mapInArrow(run, f"conv_id {kind}, cost long, audit string, illegal long"))


class _Text:
    """The repaired rows of a conversation, one edit after the other, as they stream by."""

    def __init__(self, audit: str):
        self.audit, self.next, self.last = audit, 0, NOTHING

    def _placed(self, initial: str) -> None:
        self.last = STEPS[self.last, initial]

    def _asked(self) -> str:
        return "a" if self.last == USER else "u"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.next < len(self.audit) and self.audit[self.next] == "I":
            self.next += 1
            initial = self._asked()
            self._placed(initial)
            yield ROLES[initial], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What stands in the repaired conversation up to this row."""
        yield from self.inserted()
        edit = self.audit[self.next]
        self.next += 1
        if edit != "D":
            initial = role[0] if edit == "K" else self._asked()
            self._placed(initial)
            yield role if edit == "K" else ROLES[initial], text


def repaired_rows(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    state, out = _Text(audit), []
    for role, text in rows:
        out += state.row(role, text)
    return [*out, *state.inserted()]


def _digests(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256. A conversation's audit comes before its rows; these pass one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conv, state, digest, some, out = None, None, None, None, False, []

        def put(lines: Iterator[tuple[str, str]]) -> None:
            nonlocal some
            for role, text in lines:
                digest.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                some = True

        def close() -> None:
            if state is not None:
                put(state.inserted())
                out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("repaired_sha256", pa.string())])
            for c, _, role, text, audit in zip(*[x.to_pylist() for x in batch.columns]):
                if audit is not None:
                    close()
                    conv, state, digest, some = c, _Text(audit), hashlib.sha256(), False
                else:
                    put(state.row(role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    none = F.lit(None).cast("string")
    lines = whole.select("conv_id", F.lit(-1).cast("bigint").alias("at"), none.alias("role"), none.alias("text"), "audit")
    lines = lines.union(rows.select("conv_id", "at", "role", "text", none))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return (lines.repartition("conv_id").sortWithinPartitions("conv_id", "at")
            .mapInArrow(run, f"conv_id {kind}, repaired_sha256 string"))


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation of `conversations` (conv_id): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. `rows` has conv_id, turn, role, text (role and text not NULL).
    """
    rows = saved(_faults(rows), "faults")
    whole = saved(_whole(_stretches(rows)), "repairs")
    turns = (rows.groupBy("conv_id", "turn").agg(*[F.count(F.when(F.col(c), 1)).alias(c)
                                                   for c in ("blank", "duplicate", "truncated")])
             .groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
                                     *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]))
    out = conversations.select("conv_id").distinct()
    for part in (turns, whole, _digests(rows, whole)):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "conv_id", *[F.coalesce(F.col(c).cast("bigint"), zero).alias(c)
                     for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged_repairs(conversations: DataFrame) -> DataFrame:
    """Repairs of the damaged conversations."""
    return repaired(damaged(conversations), conversations)


# The repair as a walk over the rows with the least (cost, audit) for each of the four states; CRC-32 by its table.
DAMAGED_REPAIRS_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_transform(string_split(
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
               lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS what
    FROM conversations, crc),
damaged AS (
    SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
           CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM marked, range(2) AS copies(i) WHERE what <> 0 AND (i = 0 OR what = 3)),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM damaged),
faults AS (
    SELECT *, bare = '' AS blank,
           bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
           right(bare, 1) NOT IN ('.', '!', '?') AS ends_open, left(role, 1) AS initial,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
    FROM numbered),
rows AS (
    SELECT *, ends_open AND NOT blank AND NOT duplicate AS truncated, blank OR duplicate AS gone FROM faults),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
           count(*) FILTER (truncated) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
    FROM rows GROUP BY conv_id),
walk AS (
    SELECT conv_id, 0::BIGINT AS n, {'c': 0::BIGINT, 'a': ''} AS z0, {'c': 1000000000::BIGINT, 'a': ''} AS z1,
           {'c': 3::BIGINT, 'a': 'I'} AS z2, {'c': 6::BIGINT, 'a': 'II'} AS z3
    FROM counted
    UNION ALL
    SELECT conv_id, n, y0, y1, least(y2, {'c': y3.c + 3, 'a': y3.a || 'I'}), least(y3, {'c': y2.c + 3, 'a': y2.a || 'I'})
    FROM (
        SELECT conv_id, n, x0 AS y0, x1 AS y1,
               least(x2, {'c': x0.c + 3, 'a': x0.a || 'I'}, {'c': x1.c + 3, 'a': x1.a || 'I'},
                     {'c': x3.c + 3, 'a': x3.a || 'I'}) AS y2,
               least(x3, {'c': x2.c + 3, 'a': x2.a || 'I'}) AS y3
        FROM (
            SELECT conv_id, n, {'c': z0.c + 4, 'a': z0.a || 'D'} AS x0,
                   least({'c': z1.c + 4, 'a': z1.a || 'D'},
                         {'c': z0.c + CASE WHEN initial = 's' THEN k ELSE 1000000000 END, 'a': z0.a || 'K'}) AS x1,
                   least({'c': z2.c + 4, 'a': z2.a || 'D'}, {'c': z0.c + u, 'a': z0.a || eu}, {'c': z1.c + u, 'a': z1.a || eu},
                         {'c': z3.c + u, 'a': z3.a || eu}) AS x2,
                   least({'c': z3.c + 4, 'a': z3.a || 'D'}, {'c': z2.c + a, 'a': z2.a || ea}) AS x3
            FROM (
                SELECT w.conv_id, w.n + 1 AS n, z0, z1, z2, z3, initial,
                       CASE WHEN gone THEN 1000000000 WHEN truncated THEN 3 ELSE 0 END AS k,
                       k + CASE WHEN initial = 'u' THEN 0 ELSE 3 END AS u, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS eu,
                       k + CASE WHEN initial = 'a' THEN 0 ELSE 3 END AS a, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS ea
                FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1)))),
ended AS (
    SELECT w.conv_id, least(z0, z3).c AS cost, least(z0, z3).a AS audit
    FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n),
edits AS (
    SELECT conv_id, audit, j, audit[j] AS edit, j - len(replace(left(audit, j), 'I', '')) AS inserted
    FROM ended, unnest(range(1, len(audit) + 1)) AS places(j)),
placed AS (
    SELECT e.conv_id, e.j, e.edit, r.role, r.text, r.initial,
           row_number() OVER (PARTITION BY e.conv_id ORDER BY e.j) AS o
    FROM edits e LEFT JOIN rows r
         ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.n = e.j - e.inserted AND e.edit <> 'I'
    WHERE e.edit <> 'D'),
texts AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole
    FROM (SELECT *, max(CASE WHEN o = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)
                    AS has_system FROM placed)
    GROUP BY conv_id)
SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank,
       coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit,
       sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""
