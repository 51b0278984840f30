"""Conversation structure repair by a min-plus product of turn matrices.

A conversation is whole if the initials of its roles read (s?(ua)+)?. Edits are: Keep a turn (cost 0), Rerole it to user
or assistant (1), Delete it (2; required for blank and repeated turns), Insert an empty user or assistant turn anywhere
(5); a truncated turn that is not deleted adds 5. The repair is the cheapest one; of equally cheap ones the one whose
audit, the edits' initials in order, is least in ASCII.

The reader of the initials has four states (START, S, U, A), so a turn is a 4 x 4 matrix: element (i, j) is the cheapest
(cost, audit) that takes state i over the turn to state j, inserts before it included. Matrices multiply with the least
(cost, audit) for a sum and costs added, audits joined, for a product. That is associative, and it keeps the order of
audits: two audits of the same turns that cost the same can't be one the beginning of the other, as the longer one would
have inserts beyond, which cost.

So a conversation is cut into runs of RUN turns, each run's matrices are multiplied in one task, and the products of FAN
runs meet in the next level, until one is left: a conversation of any length is spread over the cluster, and no task
holds more than RUN turns or FAN products. An element's audit has a letter a turn, so the last product of a conversation
is some 16 bytes a turn. The counts of faults and of illegal neighbours are added up in the same tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafproof.sources.store import numbered

from .common import durable

START, S, U, A = range(4)
#: state -> initial -> state
STEPS = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
INITIALS, FAULTS = ("s", "u", "a", ""), ("", "blank", "duplicate", "truncated")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
RUN, FAN = 256, 32
#: What is no white space, as in all word rules.
SOLID = r"[^\x20\x09-\x0D]"

#: 16 elements, row by row; an element that can't be is None.
Matrix = list[tuple[int, str] | None]


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [None] * 16
    for i in range(4):
        for k in range(4):
            x = a[4 * i + k]
            if x is None:
                continue
            for j in range(4):
                y = b[4 * k + j]
                if y is not None:
                    z, held = (x[0] + y[0], x[1] + y[1]), out[4 * i + j]
                    if held is None or z < held:
                        out[4 * i + j] = z
    return out


UNIT: Matrix = [(0, "") if i == j else None for i in range(4) for j in range(4)]


def _closure() -> Matrix:
    """Any number of inserts: the sum of the powers of one insert; four states need no more than three."""
    one: Matrix = list(UNIT)
    for i, steps in STEPS.items():
        for initial in ("u", "a"):
            if initial in steps:
                one[4 * i + steps[initial]] = (INSERT, "I")
    return product(product(one, one), one)


CLOSED = _closure()


def turn_matrix(initial: str, fault: str) -> Matrix:
    """Inserts, then one turn."""
    out: Matrix = [(DELETE, "D") if i == j else None for i in range(4) for j in range(4)]
    if fault not in ("blank", "duplicate"):
        more = CUT_OFF if fault == "truncated" else 0
        for i, steps in STEPS.items():
            for to in ("s", "u", "a"):
                edit = (KEEP + more, "K") if to == initial else (REROLE + more, "R")
                if to in steps and (to == initial or to != "s"):
                    at = 4 * i + steps[to]
                    out[at] = edit if out[at] is None else min(out[at], edit)
    return product(CLOSED, out)


def best(m: Matrix) -> tuple[int, str]:
    """The cheapest whole conversation: inserts after the last turn, then an end in START or A."""
    last = product(m, CLOSED)
    return min(x for x in (last[4 * START + START], last[4 * START + A]) if x is not None)


def output_roles(audit: str) -> Iterator[tuple[str, str]]:
    """(edit, role initial) of each edit; a deleted turn has none. Users and assistants come in pairs, so an odd number
    of turns begins with the system's."""
    n = len(audit) - audit.count("D")
    at = -1 if n % 2 else 0
    for edit in audit:
        if edit == "D":
            yield edit, ""
        else:
            yield edit, "s" if at < 0 else "ua"[at % 2]
            at += 1


# Spark

TREE = "costs array<bigint>, audits array<string>, sums array<bigint>"
#: sums: initial of the first turn and of the last, illegal pairs, blank, duplicate, truncated turns


def joined(a: list[int], b: list[int]) -> list[int]:
    gap = 0 if (INITIALS[a[1]], INITIALS[b[0]]) in LEGAL else 1
    return [a[0], b[1], a[2] + b[2] + gap, *(x + y for x, y in zip(a[3:], b[3:]))]


def _row(m: Matrix, sums: list[int]) -> tuple[list[int], list[str], list[int]]:
    return [-1 if x is None else x[0] for x in m], ["" if x is None else x[1] for x in m], sums


def run_product(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Codes of a run's turns in order -> their product."""
    known = [turn_matrix(INITIALS[c % 4], FAULTS[c // 4]) for c in range(16)]
    for b in batches:
        rows = []
        for codes in b:
            m, sums = UNIT, None
            for c in codes:
                m = product(m, known[c])
                one = [c % 4, c % 4, 0, *(int(c // 4 == f) for f in (1, 2, 3))]
                sums = one if sums is None else joined(sums, one)
            rows.append(_row(m, sums))
        yield pd.DataFrame(rows, columns=["costs", "audits", "sums"])


def tree_product(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Products of neighbouring runs, laid end to end -> their product."""
    for costs, audits, sums in batches:
        rows = []
        for c, a, s in zip(costs, audits, sums):
            ms = [[None if x < 0 else (int(x), w) for x, w in zip(c[k : k + 16], a[k : k + 16])] for k in range(0, len(c), 16)]
            parts = [[int(x) for x in s[k : k + 6]] for k in range(0, len(s), 6)]
            m, total = ms[0], parts[0]
            for other, part in zip(ms[1:], parts[1:]):
                m, total = product(m, other), joined(total, part)
            rows.append(_row(m, total))
        yield pd.DataFrame(rows, columns=["costs", "audits", "sums"])


def best_of(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
    rows = [best([None if x < 0 else (int(x), w) for x, w in zip(c, a)]) for c, a in zip(costs, audits)]
    return pd.DataFrame(rows, columns=["cost", "audit"])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows with faults put in by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties
    its text, 2 takes its . ! ? out, 3 repeats it, 4 makes it the user's. Null role or text (and ids in the key) are one
    space. Null turns stay null."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(name("role"))
    rows = conversations.select("conv_id", "turn", "role", "text", fault.alias("fault")).filter("fault != 0")
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys where null equals null; the keys are a's."""
    renamed = b.select(*[F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in b.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return a.join(renamed, on, how).drop(*[f"_of_{k}" for k in keys])


@dataclass
class Repair:
    report: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame  # conv_id, place (from 1), edit, role, text


def _code(initial: Column, fault: Column) -> Column:
    known = F.when(initial.isin(*INITIALS), initial).otherwise(F.lit(""))
    at = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), c) - 1
    return (at(INITIALS, known) + 4 * at(FAULTS, fault)).cast("int")


def repair(turns: DataFrame) -> Repair:
    """Find faults in conversations and put them right.

    turns: conv_id, turn, role, text. Turns are read in the order of turn (null first), then role and a digest of the
    text. A null role or text counts as empty; a null conv_id is a conversation of its own. A turn is blank without a
    character other than white space, a duplicate if its role and text were seen earlier in the conversation, truncated
    if its last such character is none of . ! ?; the first of these counts. gaps: turns that are missing between the
    least and the greatest. illegal: neighbours whose initials are not su, ua or au. Empty tables give empty results;
    other columns are ignored. A conversation without turns has no row in report, one that is deleted whole none in
    turns.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    placed = numbered(rows, ["conv_id"], ["turn", "role", "digest"], "pos")  # reads what it has written
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("first"))
    seen = _same(placed.select("conv_id", "turn", "pos", "role", "text"), first, ["conv_id", "pos"], "left")
    last = F.regexp_extract("text", rf"(?s)({SOLID})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(SOLID), "blank").when(F.col("first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    codes = durable(seen.select("conv_id", "turn", "pos", _code(F.substring("role", 1, 1), fault).alias("code")), "codes")

    runs = codes.groupBy("conv_id", F.floor((F.col("pos") - 1) / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    level = runs.select("conv_id", "run", F.pandas_udf(run_product, TREE)(F.transform("c", lambda x: x["code"])).alias("m"))
    length = (codes.agg(F.max("pos")).first()[0] or 0) - 1
    most = length // RUN
    level = durable(level.select("conv_id", "run", "m.*"), "level")
    while most > 0:
        met = level.groupBy("conv_id", F.floor(F.col("run") / FAN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("run", "costs", "audits", "sums"))).alias("p"))
        laid = [F.flatten(F.col("p")[n]) for n in ("costs", "audits", "sums")]
        level = durable(met.select("conv_id", "run", F.pandas_udf(tree_product, TREE)(*laid).alias("m")).select("conv_id", "run", "m.*"), "level")
        most //= FAN

    spans = codes.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = spans.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    found = level.select("conv_id", F.pandas_udf(best_of, "cost bigint, audit string")("costs", "audits").alias("b"), "sums")
    counts = [F.get("sums", F.lit(2 + i)).alias(n) for i, n in enumerate(("illegal", "blank", "duplicate", "truncated"))]
    report = durable(_same(found.select("conv_id", *counts, "b.cost", "b.audit"), gaps, ["conv_id"], "left").fillna(0, ["gaps"]), "report")

    kind = turns.schema["conv_id"].dataType.simpleString()

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, audit in zip(b["conv"], b["audit"]):
                pos = place = 0
                for edit, initial in output_roles(audit):
                    pos += edit != "I"
                    if edit != "D":
                        place += 1
                        new = None if edit == "K" else {"u": "user", "a": "assistant"}[initial]
                        rows.append((conv, place, -place if edit == "I" else pos, edit, new))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["conv", "place", "pos", "edit", "new"])
                        rows = []
            yield pd.DataFrame(rows, columns=["conv", "place", "pos", "edit", "new"])

    told = report.select(F.col("conv_id").cast("string").alias("conv"), "audit").mapInPandas(edits, "conv string, place bigint, pos bigint, edit string, new string")
    told = told.select(F.col("conv").cast(kind).alias("conv_id"), "place", "pos", "edit", "new")
    whole = _same(told, placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "role", "text"), ["conv_id", "pos"], "left")
    return Repair(report, whole.select("conv_id", "place", "edit", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the lines `role:text` in order of place, parted by line feeds. A conversation's lines are fed to
    the digest one after another, so one task reads them all, but holds no more than a batch."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h, none = None, None, True
        for b in batches:
            rows = []
            for conv, line in zip(b["conv"], b["line"]):
                if none or conv != now:
                    if not none:
                        rows.append((now, h.hexdigest()))
                    now, h, none = conv, sha256(line.encode()), False
                else:
                    h.update(b"\n" + line.encode())
            yield pd.DataFrame(rows, columns=["conv", "sha256"])
        if not none:
            yield pd.DataFrame([(now, h.hexdigest())], columns=["conv", "sha256"])

    lines = turns.select(F.col("conv_id").cast("string").alias("conv"), "place", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition(parts, "conv").sortWithinPartitions("conv", "place").select("conv", "line")
    return dealt.mapInPandas(feed, "conv string, sha256 string").select(F.col("conv").cast(kind).alias("conv_id"), "sha256")
