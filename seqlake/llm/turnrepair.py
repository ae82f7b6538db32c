"""Conversation structure repair: one suffix-shared automaton (DAWG) over role/fault signatures.

Every row becomes one letter: its role's initial (``s u a``, ``o`` for any other), in
capitals where the text is cut off, ``x`` where the row must go (blank or
duplicate). A conversation's letters are its signature. Signatures are sorted from
their ends and spread over tasks by ranges of that order, so equal endings
lie side by side: a node of the automaton is one distinct ending, built once for all
conversations that share it, with the cost to go and the best next edit for each
of the four grammar states. A conversation then only walks its path.

Grammar of the repaired role initials: ``(s?(ua)+)?``. Edits: Keep 0, Rerole 1, Delete 2,
Insert 5, a cut-off row left in 5 more. Of two edits with one initial at most one fits a state, so
choosing by cost, then by initial, at each step gives the ASCII-least cheapest audit.

Skew: rows are put in order by a range sort on the whole key, so a conversation of a third of all rows is
spread over many tasks, which hand on one letter and a 16-byte text key a row; copies are
counted per (conversation, text) before they are joined, and only rows that stay bring their
text to the final hash, which streams them in order with constant memory. A conversation's letters and keys
(17 bytes a row) are one cell, as its audit is in the result.

Edge cases: a null id, role or text reads as one space (a null id is one conversation);
a null turn sorts first and counts for no gap; rows of one turn are ordered by role, then text md5,
then copy; an empty role fits no place of the grammar; repeated rows are duplicates; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqlake.session import materialize

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. What each needs next, and where that leads.
NEED, NEXT = "uuau", (2, 2, 3, 2)
END = ((0, ""), (10, "I"), (5, "I"), (0, ""))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the seeded damage of the rows."""
    t = conversations
    space = lambda c: F.coalesce(t[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = t.select(t["conv_id"], t["turn"], space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    return rows.filter("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows in slim form with their fault, distinct texts per conversation)``; texts are written once."""
    rows = rows.withColumn("d", F.unhex(F.md5(F.concat_ws("\x01", F.hex(F.encode("role", "utf-8")), F.col("text")))))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    texts = rows.groupBy("conv_id", "d").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n"),
                                             F.first("role").alias("role"), F.first("text").alias("text"))
    texts = materialize(texts, "repair-texts")
    again = texts.filter("n > 1").select(F.col("conv_id").alias("c2"), F.col("d").alias("d2"), "first")
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select("conv_id", "turn", "role", "d", (ended == "").alias("blank"),
                       (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("cut"))
    # equal rows of a turn are counted first, then numbered
    slim = slim.groupBy("conv_id", "turn", "role", "d", "blank", "cut").agg(F.count(F.lit(1)).alias("m"))
    slim = slim.join(again, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("d") == F.col("d2")), "left")
    slim = slim.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    blank = F.col("blank")
    duplicate = ~blank & F.coalesce((turn > F.col("first")) | (F.col("copy") > 1), F.lit(False))
    truncated = ~blank & ~duplicate & F.col("cut")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return slim.select(
        "conv_id", "turn", "role", "d", "copy", blank.cast("int").alias("blank"), duplicate.cast("int").alias("duplicate"),
        truncated.cast("int").alias("truncated"), initial.alias("initial"),
        F.when(blank | duplicate, "x").when(truncated, F.upper(initial)).otherwise(initial).alias("letter")), texts


def _signatures(slim: DataFrame) -> DataFrame:
    """``conv_id, sig, initials, keys``: each conversation's letters, role initials and text keys in row order."""
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("d"), F.col("copy")]
    placed = slim.select("conv_id", "turn", "role", "d", "copy", "letter", "initial").repartitionByRange(*key).sortWithinPartitions(*key)
    placed = placed.select("conv_id", "letter", "initial", "d", F.spark_partition_id().alias("part"))
    id_type = slim.schema["conv_id"].dataType.simpleString()

    def runs(batches):
        """One row per conversation and task, also where it goes on in the next batch."""
        now, part, held = None, 0, None
        for batch in batches:
            ids, letters, initials, keys = (batch.column(i).to_pylist() for i in range(4))
            part = batch.column(4)[0].as_py() if len(ids) else part
            out = []
            for c, a, b, k in zip(ids, letters, initials, keys):
                if held is None or c != now:
                    if held is not None:
                        out.append((now, held))
                    now, held = c, ([], [], [])
                held[0].append(a), held[1].append(b), held[2].append(k)
            if out:
                yield _run_batch(out, part)
        if held is not None:
            yield _run_batch([(now, held)], part)

    arrow_id = to_arrow_type(slim.schema["conv_id"].dataType)

    def _run_batch(out, part):
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in out], arrow_id), pa.array([part] * len(out), pa.int32()),
             pa.array(["".join(h[0]) for _, h in out]), pa.array(["".join(h[1]) for _, h in out]),
             pa.array([b"".join(h[2]) for _, h in out], pa.binary())], names=["conv_id", "part", "sig", "initials", "keys"])

    pieces = placed.mapInArrow(runs, f"conv_id {id_type}, part int, sig string, initials string, keys binary")
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "sig", "initials", "keys"))).alias("p"))
    glue = lambda f: F.concat_ws("", F.transform("p", lambda x: x[f]))
    keys = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["keys"]))
    return whole.select("conv_id", glue("sig").alias("sig"), glue("initials").alias("initials"), keys.alias("keys"))


class SuffixAutomaton:
    """The current path of the automaton: one node per ending of the signature at hand, shared with its sorted neighbours.

    A node holds, per grammar state, the cost to go and the edits (initials) up to the next row.
    """

    def __init__(self) -> None:
        self.path: list[str] = []
        self.nodes: list[tuple] = [END]
        self.built = 0

    def _node(self, letter: str, after: tuple) -> tuple:
        low, extra = letter.lower(), CUT if letter.isupper() else 0
        here = []
        for state in range(4):
            best = (DELETE + after[state][0], "D", state)
            if low != "x":
                if low == NEED[state] or (low == "s" and state == 0):
                    to = 1 if low == "s" else NEXT[state]
                    best = min(best, (KEEP + extra + after[to][0], "K", to))
                best = min(best, (REROLE + extra + after[NEXT[state]][0], "R", NEXT[state]))
            here.append(best)
        two = min(here[2], (INSERT + here[3][0], "I", 3))
        three = min(here[3], (INSERT + here[2][0], "I", 2))
        here = [min(here[0], (INSERT + two[0], "I", 2)), min(here[1], (INSERT + two[0], "I", 2)), two, three]
        self.built += 1
        return tuple(here)

    def move_to(self, sig: str) -> None:
        """Keep the nodes of the ending shared with the last signature and build the rest."""
        back = sig[::-1]
        same = 0
        for a, b in zip(self.path, back):
            if a != b:
                break
            same += 1
        del self.path[same:], self.nodes[same + 1:]
        for letter in back[same:]:
            self.nodes.append(self._node(letter, self.nodes[-1]))
            self.path.append(letter)

    def repair(self) -> tuple[int, str, list[tuple[int, str]]]:
        """``(cost, audit, [(row or -1 for an insert, new role's initial or '' to keep)])`` from the start state."""
        audit, items, state = [], [], 0
        for row, node in enumerate(reversed(self.nodes[1:])):
            while True:
                _, edit, to = node[state]
                audit.append(edit)
                if edit == "I":
                    items.append((-1, NEED[state]))
                    state = to
                    continue
                if edit != "D":
                    items.append((row, NEED[state] if edit == "R" else ""))
                state = to
                break
        while END[state][0]:
            audit.append("I")
            items.append((-1, NEED[state]))
            state = NEXT[state]
        return self.nodes[-1][0][0], "".join(audit), items


LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant", "": None}


def _repaired(signatures: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit, items``: the automaton runs over the signatures sorted from their ends."""
    back = F.reverse("sig")
    spread = signatures.select("conv_id", "sig", "initials", "keys", back.alias("back"))
    spread = spread.repartitionByRange("back", "conv_id").sortWithinPartitions("back", "conv_id").drop("back")
    id_type = signatures.schema["conv_id"].dataType.simpleString()
    item = pa.struct([("role", pa.string()), ("d", pa.binary())])

    def walk(batches):
        automaton, last, found = SuffixAutomaton(), None, None
        for batch in batches:
            illegal, costs, audits, plans = [], [], [], []
            for sig, initials, keys in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if sig != last:
                    automaton.move_to(sig)
                    last, found = sig, automaton.repair()
                cost, audit, items = found
                illegal.append(sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1)))
                costs.append(cost)
                audits.append(audit)
                plans.append([(ROLES[role], None if row < 0 else keys[16 * row:16 * row + 16]) for row, role in items])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()),
                 pa.array(plans, pa.list_(item))], names=["conv_id", "illegal", "cost", "audit", "items"])

    return spread.mapInArrow(walk, f"conv_id {id_type}, illegal long, cost long, audit string, items array<struct<role:string,d:binary>>")


def repaired_turns(plans: DataFrame, texts: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the repaired conversations' rows, ``place`` from 0."""
    items = plans.select("conv_id", F.posexplode("items").alias("place", "item")).select(
        "conv_id", "place", F.col("item.role").alias("new"), F.col("item.d").alias("d"))
    texts = texts.select(F.col("conv_id").alias("c2"), F.col("d").alias("d2"), F.col("role").alias("old"), "text")
    j = items.join(texts, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("d") == F.col("d2")), "left")
    return j.select("conv_id", "place", F.coalesce("new", "old").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _hashes(turns: DataFrame) -> DataFrame:
    """``c, repaired_sha256`` per conversation: its lines stream past in order, nothing is gathered."""
    lines = turns.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    id_type = turns.schema["conv_id"].dataType.simpleString()
    arrow_id = to_arrow_type(turns.schema["conv_id"].dataType)

    def digest(batches):
        now, h = None, None
        for batch in batches:
            out = []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h is not None and c == now:
                    h.update(b"\n")
                else:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = c, hashlib.sha256()
                h.update(line.encode("utf-8"))
            yield _pairs(out)
        if h is not None:
            yield _pairs([(now, h.hexdigest())])

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], arrow_id), pa.array([s for _, s in out], pa.string())],
                                          names=["c", "repaired_sha256"])

    return lines.mapInArrow(digest, f"c {id_type}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(report per conversation, repaired rows)`` of ``rows(conv_id, turn, role, text)``."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    slim, texts = _marked(rows)
    slim = materialize(slim, "repair-rows")
    plans = materialize(_repaired(_signatures(slim)), "repair-plans")
    turns = repaired_turns(plans, texts)
    counts = slim.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    report = counts.join(plans.select(F.col("conv_id").alias("c1"), "illegal", "cost", "audit"), same("conv_id", "c1"), "left")
    report = report.join(_hashes(turns), same("conv_id", "c"), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    report = report.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
                           "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
    return report, turns


def damage_report(conversations: DataFrame) -> DataFrame:
    """One row per original conversation: faults, cost, audit and hash after the seeded damage and its repair."""
    report, _ = repair(damaged(conversations))
    every = conversations.select(conversations["conv_id"].alias("id")).distinct()
    j = every.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return j.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
