"""Conversation structure repair: error-correcting Earley parsing of the roles, in segments that are joined afterwards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from skyloom.llm.common import read_table, shared_table

#: Rules of the roles' grammar, ``(s?(ua)+)?``. Z takes what is deleted after the end. Nonterminals stand first in a rule
#: alone, and recursion is to the left, so every item of a chart begins where the conversation begins, and a set holds an
#: item a place in a rule at most.
GRAMMAR = (("Z", "S"), ("S", ""), ("S", "P"), ("P", "Hua"), ("P", "Pua"), ("H", ""), ("H", "s"))
TERMINALS = "sua"
#: Roles that may be given or inserted, by their initials.
GIVEN = {"u": "user", "a": "assistant"}
#: Initials of roles that may follow each other.
LEGAL = ("su", "ua", "au")
#: Costs of edits, and of a row that is left truncated.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and characters of a segment; longer conversations are parsed in several.
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 17
#: Non-blank characters, and what ends a whole row.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"

_START, _END = (0, 0), (0, 1)
_LEADS = {x: [i for i, (_, rhs) in enumerate(GRAMMAR) if rhs[:1] == x] for x in "ZSPH"}
#: What a place is before: a terminal, a nonterminal or nothing.
_NEXT = {(i, d): rhs[d : d + 1] for i, (_, rhs) in enumerate(GRAMMAR) for d in range(len(rhs) + 1)}


def _closed(items: dict) -> dict:
    """``items`` of a set with what completing, predicting and inserting add; each keeps its least (cost, audit)."""
    todo = list(items)
    while todo:
        at = todo.pop()
        cost, audit = items[at]
        after = _NEXT[at]
        if not after:  # a whole rule: the rules that wait for it, at the start of the chart, move on
            moved = [((i, 1), (cost, audit)) for i in _LEADS.get(GRAMMAR[at[0]][0], ())]
        elif after in GIVEN:
            moved = [((at[0], at[1] + 1), (cost + INSERT, audit + "I"))]
        elif after in TERMINALS:
            moved = []
        else:
            moved = [((i, 0), (cost, audit)) for i, (lhs, _) in enumerate(GRAMMAR) if lhs == after]
        for to, value in moved:
            if to not in items or value < items[to]:
                items[to] = value
                todo.append(to)
    return items


def _scanned(items: dict, initial: str, must_go: bool, truncated: bool) -> dict:
    """The set after a row: items before a terminal keep, rerole or delete it; a finished chart deletes it."""
    out: dict = {}

    def put(to, cost, audit):
        if to not in out or (cost, audit) < out[to]:
            out[to] = (cost, audit)

    extra = TRUNCATED if truncated else 0
    for at, (cost, audit) in items.items():
        after = _NEXT[at]
        if at == _END or (after and after in TERMINALS):
            put(at, cost + DELETE, audit + "D")
        if not after or after not in TERMINALS or must_go:
            continue
        further = (at[0], at[1] + 1)
        if initial == after:
            put(further, cost + KEEP + extra, audit + "K")
        elif after in GIVEN:
            put(further, cost + REROLE + extra, audit + "R")
    return _closed(out)


def parse(rows: list[tuple[str, bool, bool]], start: tuple[int, int] = _START) -> dict:
    """The last set of the chart over ``rows`` (initial, must go, truncated) from the item ``start``: item to (cost, audit)."""
    items = _closed({start: (0, "")})
    for row in rows:
        items = _scanned(items, *row)
    return items


#: Items that a set may hand to the next segment: all that stand before a terminal, and the end.
_DOORS = [at for at, after in _NEXT.items() if at == _END or (after and after in TERMINALS)]


def _transfers(rows: list[tuple[str, bool, bool]]) -> list[dict]:
    """Least (cost, audit) over ``rows`` from each door ``a`` to each door ``b``.

    What closes a door is in its own set with values no worse, so each way starts from a door alone.
    """
    out = []
    for i, door in enumerate(_DOORS):
        items = {door: (0, "")}
        for row in rows:
            items = _scanned(items, *row)
        out += [{"a": i, "b": _DOORS.index(at), "cost": c, "audit": s} for at, (c, s) in items.items() if at in _DOORS]
    return out


def _role_at(door: tuple[int, int]) -> str:
    """The role's initial that a chart at ``door`` has given last, as far as the next one depends on it."""
    return "u" if _NEXT[door] == "a" else ""


def repaired_lines(rows: list[tuple[str, str]], audit: str, last: str = "") -> list[str]:
    """``role:text`` of the repaired conversation by the ``audit`` of its ``rows`` (role, text), after a role of initial ``last``."""
    out, i = [], 0
    for edit in audit:
        given = "a" if last == "u" else "u"
        if edit == "I":
            out.append(GIVEN[given] + ":")
            last = given
            continue
        role, text = rows[i]
        i += 1
        if edit == "K":
            out.append(f"{role}:{text}")
            last = role[:1]
        elif edit == "R":
            out.append(f"{GIVEN[given]}:{text}")
            last = given
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` of ``conversations`` after damage by ``crc32(conv_id:turn) % 20``.

    0 drops a row (no copies), 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role user. Null roles
    and texts are one space, as are null ids and turns in what is hashed; a null turn stays null.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    held = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("h"),
    )
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)
    return held.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies")
    )


def _by(names: list[str], a: DataFrame, b: DataFrame) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[f"_{n}"])
    return on


def _faulted(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their ``copies``, and whether their role and text come ``first`` here in the conversation."""
    keys = ["conv_id", "turn", "role", "digest"]
    digest = F.sha2("text", 256)
    one = rows.withColumn("digest", digest).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    when = F.struct(F.col("turn").isNotNull().alias("is"), F.col("turn"))
    firsts = rows.withColumn("digest", digest).groupBy("conv_id", "role", "digest").agg(F.min(when).alias("at"))
    firsts = firsts.select(
        F.col("conv_id").alias("_conv_id"), F.col("at.turn").alias("_turn"), F.col("role").alias("_role"), F.col("digest").alias("_digest")
    )
    joined = one.join(firsts, _by(keys, one, firsts), "left")
    return joined.select("conv_id", "turn", "role", "text", "copies", F.col("_role").isNotNull().alias("first"))


class _Segment:
    """Rows of a conversation that follow each other, up to a bound."""

    def __init__(self):
        self.rows, self.lines, self.chars = [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.turn_a = self.turn_b = None
        self.before = None  # the initial of the row before

    def add(self, turn, role: str, text: str, is_first: bool) -> None:
        initial = role[:1]
        shown = text.rstrip(BLANKS)
        must_go, cut = True, False
        if not shown:
            self.blank += 1
        elif not is_first:
            self.duplicate += 1
        else:
            must_go, cut = False, shown[-1] not in ENDS
            self.truncated += cut
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.turn_b:
            self.turns += 1
            self.turn_a = turn if self.turn_a is None else self.turn_a
            self.turn_b = turn
        self.rows.append((initial, must_go, cut))
        self.lines.append((role, "" if must_go else text))
        self.chars += 0 if must_go else len(text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS


#: What segments of a conversation add up, and what else comes of one.
_TALLIES = ("turns", "blank", "duplicate", "truncated", "illegal")
_SEGMENT = (
    "part int, seq long, closed boolean, turn_a {turn}, turn_b {turn}, head string, tail string, "
    + ", ".join(f"{t} long" for t in _TALLIES)
    + ", cost long, audit string, sha string, ways array<struct<a:int,b:int,cost:long,audit:string>>, lines array<struct<role:string,text:string>>"
)
_PATH = "part int, seq long, piece string, last string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _schema(like: DataFrame, rest: str) -> StructType:
    """``rest`` after the conversation's id, with the types that ``like`` has."""
    conv = like.schema["conv_id"].dataType
    turn = like.schema["turn"].dataType.simpleString() if "turn" in like.columns else ""
    return StructType([StructField("conv_id", conv), *_parse_datatype_string(rest.replace("{turn}", turn)).fields])


def _in_batches(schema: StructType, records: Iterator[dict], rows: int = 512, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches of ``rows`` rows, or fewer where they hold ``chars`` characters."""
    arrow = to_arrow_schema(schema)
    held, size = [], 0
    for r in records:
        held.append(r)
        size += sum(len(x["text"]) for x in r.get("lines") or ()) + len(r.get("audit") or "") + len(r.get("body") or "")
        if len(held) >= rows or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def _segments(rows: DataFrame) -> DataFrame:
    """Segments of conversations: range partitions of rows in order are cut at ends of conversations and at the bounds.

    A conversation that lies within a partition, in one segment, is parsed and hashed at once (``closed``); of others a
    segment keeps the least costs from each door of the chart to each, and its rows.
    """
    schema = _schema(rows, _SEGMENT)
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def record(conv_id, part: int, seq: int, seg: _Segment, closed: bool) -> dict:
        out = {"conv_id": conv_id, "part": part, "seq": seq, "closed": closed, "turn_a": seg.turn_a, "turn_b": seg.turn_b}
        out |= {t: getattr(seg, t) for t in _TALLIES}
        if not closed:
            lines = [{"role": r, "text": t} for r, t in seg.lines]
            return out | {"head": seg.rows[0][0], "tail": seg.rows[-1][0], "ways": _transfers(seg.rows), "lines": lines}
        cost, audit = parse(seg.rows)[_END]
        body = "\n".join(repaired_lines(seg.lines, audit))
        return out | {"cost": cost, "audit": audit, "sha": hashlib.sha256(body.encode()).hexdigest()}

    def records(batches):
        # a partition's first conversation may have begun before it, its last one may go on after it
        seg, seq, whole, now, part = None, 0, False, None, None
        for row in _rows_of(batches):
            part = row["part"]
            if seg is None:
                seg, now = _Segment(), row["conv_id"]
            elif row["conv_id"] != now:
                yield record(now, part, seq, seg, whole)
                seg, seq, whole, now = _Segment(), seq + 1, True, row["conv_id"]
            for i in range(row["copies"]):
                if seg.full():
                    yield record(now, part, seq, seg, False)
                    seg, seq, whole = _Segment(), seq + 1, False
                seg.add(row["turn"], row["role"], row["text"], row["first"] and not i)
        if seg is not None:
            yield record(now, part, seq, seg, False)

    return dealt.withColumn("part", F.spark_partition_id()).mapInArrow(lambda b: _in_batches(schema, records(b)), schema)


def _told(pieces) -> str:
    """The text of a chain of pieces, the last one first."""
    out = []
    while pieces:
        pieces, piece = pieces
        out.append(piece)
    return "".join(reversed(out))


def _joined(ways: list[list[dict]]) -> tuple[int, list[tuple[str, int]], str]:
    """The least (cost, audit) through segments in order.

    Returns its cost, each segment's audit with the door it begins at, and what the audit has before the first row.
    """
    start = _closed({_START: (0, "")})
    heads = [(start[at][0], (None, start[at][1])) if at in start else None for at in _DOORS]
    came = []
    for segment in ways:
        best, back = [None] * len(_DOORS), [None] * len(_DOORS)
        for w in segment:
            if heads[w["a"]] is None:
                continue
            cost = heads[w["a"]][0] + w["cost"]
            chain = (heads[w["a"]][1], w["audit"])
            held = best[w["b"]]
            if held is None or cost < held[0] or (cost == held[0] and _told(chain) < _told(held[1])):
                best[w["b"]], back[w["b"]] = (cost, chain), (w["a"], w["audit"])
        heads = best
        came.append(back)
    at = _DOORS.index(_END)
    cost, path = heads[at][0], []
    for back in reversed(came):
        at, audit = back[at]
        path.append((audit, at))
    path.reverse()
    return cost, path, start[_DOORS[path[0][1]]][1]


def _paths(opens: DataFrame) -> DataFrame:
    """For each open segment the audit that the best repair of its conversation has there; the first has the totals, too.

    A task holds the ways of one conversation, without its texts: some characters a row, as the audit itself.
    """
    schema = _schema(opens, _PATH)
    order = ["conv_id", "part", "seq"]
    narrow = opens.drop("lines", "closed", "cost", "audit", "sha").repartition("conv_id").sortWithinPartitions(*order)

    def records(batches):
        held: list[dict] = []

        def settled():
            cost, path, begun = _joined([s["ways"] for s in held])
            total = {t: sum(s[t] for s in held) for t in _TALLIES}
            low = last = None
            for i, s in enumerate(held):
                total["illegal"] += bool(i) and held[i - 1]["tail"] + s["head"] not in LEGAL
                if s["turn_a"] is not None:
                    total["turns"] -= s["turn_a"] == last
                    low, last = (s["turn_a"] if low is None else low), s["turn_b"]
            gaps = 0 if last is None else last - low + 1 - total["turns"]
            total.pop("turns")
            audit = begun + "".join(a for a, _ in path)
            for i, (s, (piece, door)) in enumerate(zip(held, path)):
                out = {"conv_id": s["conv_id"], "part": s["part"], "seq": s["seq"], "piece": piece, "last": _role_at(_DOORS[door])}
                if not i:  # what is inserted before the first row is in the first piece
                    out |= {"piece": begun + piece, "last": "", "gaps": gaps, "cost": cost, "audit": audit, **total}
                yield out

        for row in _rows_of(batches):
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield from settled()
                held = []
            held.append(row)
        if held:
            yield from settled()

    return narrow.mapInArrow(lambda b: _in_batches(schema, records(b)), schema)


def _hashed(opens: DataFrame, paths: DataFrame) -> DataFrame:
    """Results of conversations of more than one segment: their repaired lines are hashed in order, a segment at a time."""
    body = _schema(opens.select("conv_id"), _PATH + ", n_lines int, body string")
    result = _schema(opens.select("conv_id"), _RESULT)
    at = ["part", "seq"]
    joined = paths.join(opens.select(*at, "lines"), at).select(*[f.name for f in body if f.name not in ("n_lines", "body")], "lines")

    def bodies(batches):
        for row in _rows_of(batches):
            lines = repaired_lines([(x["role"], x["text"]) for x in row["lines"]], row["piece"], row["last"])
            yield row | {"lines": None, "n_lines": len(lines), "body": "\n".join(lines)}

    def records(batches):
        out, sha, begun = None, None, False
        for row in _rows_of(batches):
            if row["cost"] is not None:  # a conversation's first segment
                if out:
                    yield out | {"repaired_sha256": sha.hexdigest()}
                out, sha, begun = {c: row[c] for c in result.names if c in row}, hashlib.sha256(), False
            if row["n_lines"]:
                sha.update(("\n" if begun else "").encode() + row["body"].encode())
                begun = True
        if out:
            yield out | {"repaired_sha256": sha.hexdigest()}

    made = joined.mapInArrow(lambda b: _in_batches(body, bodies(b)), body)
    in_order = made.repartition("conv_id").sortWithinPartitions("conv_id", *at)
    return in_order.mapInArrow(lambda b: _in_batches(result, records(b)), result)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of the roles of each conversation in ``rows`` (conv_id, turn, role, text, copies).

    Rows of a conversation are taken by turn, nulls first, those of one turn by role and text; ``copies`` of a row follow
    each other. A row's first fault counts: blank, duplicate (its role and text came before), truncated. Edits: keep
    (free), rerole to user or assistant (3), delete (4, a must for blank and duplicate rows), insert an empty user or
    assistant row (3); 3 more for a truncated row that stays. ``audit`` has the initials of the cheapest edits that make
    roles ``(s?(ua)+)?``, of equal ones the ASCII-least; ``cost`` is theirs; ``repaired_sha256`` is that of the repaired
    ``role:text`` lines. ``gaps``: turns missing between the least and the greatest; ``illegal``: neighbours that are not
    system and user, user and assistant, or assistant and user by their initials. A null id is a conversation of its own;
    a row of an empty role cannot be kept. Null roles and texts must be replaced before. No rows, no result.

    Conversations of any length are cut into segments of ``SEGMENT_ROWS`` rows, whose charts are joined: no task holds
    the texts of a conversation, but one goes through them, as a hash must.
    """
    faulted = _faulted(rows)
    segments = shared_table(_segments(faulted), "segments")
    done = segments.filter("closed")
    low_high = (F.col("turn_b") - F.col("turn_a") + 1 - F.col("turns")).cast("long")
    gaps = F.when(F.col("turn_a").isNull(), F.lit(0).cast("long")).otherwise(low_high)
    names = [f.name for f in _parse_datatype_string(_RESULT).fields]
    whole = done.select("conv_id", gaps.alias("gaps"), *names[1:-1], F.col("sha").alias(names[-1]))
    opens = segments.filter("not closed")
    paths = shared_table(_paths(opens), "paths")
    return whole.unionByName(_hashed(opens, paths))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, its faults after damage, and the cheapest repair of its roles.

    Conversations of which no row is left have zeros, an empty audit and the hash of an empty string.
    """
    given = read_table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged(given).filter("copies > 0"))
    found = found.withColumnRenamed("conv_id", "_conv_id")
    ids = given.select("conv_id").distinct()
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    longs = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["_conv_id"]), "left")
    return joined.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
