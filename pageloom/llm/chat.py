"""Chat transcripts: a hidden Markov model over speaker markers and line features recovers roles.

A conversation is read as lines without roles. The hidden state of a line is a role, and whether the
line begins a turn or goes on with one. What a state shows are features of the line: its speaker
marker, whether a gap comes before it, its ending, its length and its opening. Counts over labelled
conversations give the model; Viterbi gives the roles; lines of one turn are rendered together.

A long conversation spreads over range partitions. The best scores between any state at a part's
start and any at its end form a small matrix; chaining the matrices of a conversation's parts, one
row each, fixes the states at the borders, and each part then runs Viterbi between its borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.tables import saved
from pageloom.session import ship_by_value

ship_by_value(__name__)

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role, then role + 3 for a line that goes on
#: Conversations that the model is learned from, by a hash of the id.
SAMPLE_CONVERSATIONS = 20_000
#: Share of turns that are taken to begin with a speaker marker, and without a gap, beside those counted.
MARKED_SHARE = 0.005
#: Rows of a part, about: a conversation with more is solved in several tasks.
PART_ROWS = 50_000
# fixed values: speaker markers at the start of a line
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "gpt", "chatbot"),
}
OPENINGS = {"question": ("what", "how", "why", "who", "when", "where", "can", "could", "is", "are", "do", "does", "please"),
            "reply": ("sure", "certainly", "to", "yes", "no", "here", "of", "sorry", "thanks"),
            "rule": ("you", "always", "never", "answer", "act", "follow")}
FEATURES = (5, 2, 5, 7, 5)  # values of each feature: marker, gap, ending, length, opening


def marker_pattern() -> re.Pattern:
    names = "|".join(sorted((n for group in MARKERS.values() for n in group), key=len, reverse=True))
    return re.compile(rf"^\s*(<\|(?:im_start\|>)?|\[|#+\s*|\*\*)?\s*(?P<name>{names})\s*(?P<close>\|>|\]|\*\*)?\s*(?P<end>:|>|$)\s*", re.I)


def _cut(found: re.Match) -> int:
    """Where the text begins after a marker that a delimiter ends; 0 for a name alone on its line, which may be text."""
    if not (found["end"] or found["close"] in ("|>", "]") or (found[1] or "").lower() == "<|im_start|>"):
        return 0
    bold = found[1] == "**" and not found["close"] and found.string.startswith("**", found.end())
    return re.compile(r"\*\*\s*").match(found.string, found.end()).end() if bold else found.end()


class Line(NamedTuple):
    """A line as it is, the blank lines before it, and where its text begins after a marker (0: there is none), with the marker's role."""

    text: str
    blank: int
    cut: int
    role: int


class Reader:
    """Lines of a turn's text as feature values."""

    def __init__(self) -> None:
        self.pattern = marker_pattern()
        self.role = {n: i + 1 for i, r in enumerate(ROLES) for n in MARKERS[r]}
        self.opening = {w: i + 1 for i, group in enumerate(OPENINGS.values()) for w in group}

    def lines(self, text: str | None) -> list[tuple[Line, tuple[int, ...]]]:
        out = []
        blank = 0
        gap = True  # a row of the table begins after a gap
        for line in (text or "").split("\n"):
            body = line.strip()
            if not body:
                gap = True
                blank += 1
                continue
            line = line.rstrip("\r")
            found = self.pattern.match(line)
            marker = self.role.get(found["name"].lower(), 4) if found else 0
            shown = Line(line, blank, _cut(found) if found else 0, marker - 1)
            if found:
                body = line[found.end():].strip()
            end = {"?": 1, ".": 2, ":": 3, "!": 4}.get(body[-1:], 0)
            first = body.split(maxsplit=1)
            word = re.sub(r"\W", "", first[0].lower()) if first else ""
            length = min(int(np.log2(len(body) + 1)) // 2, 6)
            out.append((shown, (marker, int(gap), end, length, self.opening.get(word, 4 if word else 0))))
            gap, blank = False, 0
        return out or [(Line("", 0, 0, -1), (0, 1, 0, 0, 0))]


class Model:
    """Log probabilities: first state, next state, and each feature's value by state."""

    def __init__(self, first: np.ndarray, following: np.ndarray, shown: list[np.ndarray]) -> None:
        norm = lambda c: np.log((c + 0.1) / (c + 0.1).sum(axis=-1, keepdims=True))
        self.first, self.following = norm(first), norm(following)
        self.following[:, 3:] = np.where(np.eye(3, dtype=bool)[np.arange(6) % 3], self.following[:, 3:], -1e9)  # a turn goes on with its role
        self.first[3:] = -1e9
        self.shown = [norm(c) for c in shown]

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Score of each state for each line."""
        return sum(table[:, features[:, k]].T for k, table in enumerate(self.shown))

    def through(self, scores: np.ndarray) -> np.ndarray:
        """Best score from each state of the line before to each state of the last line."""
        best = self.following + scores[0]
        for s in scores[1:]:
            best = (best[:, :, None] + self.following[None]).max(axis=1) + s
        return best

    def opened(self, scores: np.ndarray) -> np.ndarray:
        """Best score of each state of the last line, if the conversation begins here."""
        best = self.first + scores[0]
        for s in scores[1:]:
            best = (best[:, None] + self.following).max(axis=0) + s
        return best

    def path(self, scores: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
        """The best states, given the state of the line before (None: the conversation begins) and the last one."""
        best = (self.first if before is None else self.following[before]) + scores[0]
        back = np.zeros((len(scores), STATES), np.int64)
        for i, s in enumerate(scores[1:], 1):
            options = best[:, None] + self.following
            back[i] = options.argmax(axis=0)
            best = options.max(axis=0) + s
        states = np.empty(len(scores), np.int64)
        states[-1] = best.argmax() if last is None else last
        for i in range(len(scores) - 1, 0, -1):
            states[i - 1] = back[i, states[i]]
        return states


def learn(turns: DataFrame) -> Model:
    """A model from ``turns(conv_id, turn, role, text)``; roles other than the three and conversations without id teach nothing.

    About ``SAMPLE_CONVERSATIONS`` conversations are counted. Neighbouring turns are counted through
    windows within parts of a conversation, so that none is sorted as a whole.
    """
    rows = turns.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    n = rows.agg(F.approx_count_distinct("conv_id")).first()[0]
    share = min(1.0, SAMPLE_CONVERSATIONS / n) if n else 1.0
    rows = rows.where(F.pmod(F.xxhash64(F.lit("chat"), "conv_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = rows.select("conv_id", "turn", "role", "text")
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        counts: dict[tuple, int] = {}
        conv, state = None, -1
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                for k, (_, features) in enumerate(reader.lines(text)):
                    now = ROLES.index(role) + (3 if k else 0)
                    keys = [(0, -1 if c != conv else state, now), *((1 + f, now, v) for f, v in enumerate(features))]
                    for key in keys:
                        counts[key] = counts.get(key, 0) + 1
                    conv, state = c, now
        if counts:
            kind, a, b = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                                              pa.array(list(counts.values()), pa.int64())], ["kind", "a", "b", "n"])

    first, following = np.zeros(STATES), np.zeros((STATES, STATES))
    shown = [np.zeros((STATES, v)) for v in FEATURES]
    for r in rows.mapInArrow(run, "kind int, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        if r.kind:
            shown[r.kind - 1][r.a, r.b] += r.n
        elif r.a < 0:
            first[r.b] += r.n
        else:
            following[r.a, r.b] += r.n
    for k in range(len(ROLES)):  # turns may begin with their marker, and without a gap, where no training turn does
        shown[0][k, k + 1] += MARKED_SHARE * shown[0][k].sum() + 1
        shown[1][k, 0] += MARKED_SHARE * shown[1][k].sum() + 1
    return Model(first, following, shown)


def _segments(conv: list) -> list[tuple[int, int]]:
    """Runs of equal neighbours."""
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return list(zip(cuts, cuts[1:])) if conv else []


def parsed(turns: DataFrame, model: Model) -> DataFrame:
    """``(conv_id, turn, role_pred, line_roles, n_lines, rendered)`` for each row of ``turns(conv_id, turn, text)``.

    Rows of a conversation count in the order of turn (null first), then text. ``role_pred`` is the
    role of the row's first line, ``line_roles`` has the first letter of each line's role, upper case
    where a turn begins, and ``rendered`` holds the row's lines, each turn under a ``<|role|>`` header;
    the rows' texts one after the other are the canonical transcript. Lines are as they were, but for a
    speaker marker with a delimiter where a turn of its role begins. Blank lines before a turn and at
    a row's end are left out; a null or blank text is one empty line. Rows without conv_id form one conversation.
    """
    spark = turns.sparkSession
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("text").cast("string"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    # both passes must see the same cut, so that it is written once
    cut = saved(rows.repartitionByRange(parts, "conv_id", "turn", "tie").withColumn("part", F.spark_partition_id()), "turns")

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).sort_by([("part", "ascending"), ("conv_id", "ascending"), ("turn", "ascending"), ("tie", "ascending")])
            for a, b in _segments(table.column("part").to_pylist()):
                yield table.column("part")[a].as_py(), table.slice(a, b - a)

    def features(reader: Reader, texts: list) -> tuple[np.ndarray, list[int]]:
        each = [[f for _, f in reader.lines(t)] for t in texts]
        return np.array([f for lines in each for f in lines]), [len(lines) for lines in each]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, m = Reader(), cloudpickle.loads(shared.value)
        for part, table in by_part(batches):
            convs, texts = table.column("conv_id").to_pylist(), table.column("text").to_pylist()
            whole = _segments(convs)
            for a, b in {whole[0], whole[-1]}:  # only these may go on in another part
                f = features(reader, texts[a:b])[0]
                yield pa.RecordBatch.from_arrays([
                    pa.array([convs[a]], pa.int64()), pa.array([part], pa.int32()),
                    pa.array([m.through(m.scores(f)).reshape(-1)], pa.list_(pa.float64())),
                    pa.array([m.opened(m.scores(f))], pa.list_(pa.float64()))], ["conv_id", "part", "through", "opened"])

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        """States at the borders of the parts of one conversation: one row per part comes in and goes out."""
        table = table.sort_by("part")
        through = np.array(table.column("through").to_pylist()).reshape(-1, STATES, STATES)
        best, back = np.array(table.column("opened")[0].as_py()), []
        for step in through[1:]:
            options = best[:, None] + step
            back.append(options.argmax(axis=0))
            best = options.max(axis=0)
        last = [int(best.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last = last[::-1]
        return pa.table({"conv_id": table.column("conv_id"), "part": table.column("part"),
                         "before": pa.array([None, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})

    narrow = cut.select("part", "conv_id", "turn", "tie", "text")
    grouped = narrow.repartition(parts, "part")
    ends = grouped.mapInArrow(matrices, "conv_id bigint, part int, through array<double>, opened array<double>")
    borders = saved(ends.groupBy("conv_id").applyInArrow(chain, "conv_id bigint, part int, before int, last int"), "borders")
    borders = borders.groupBy("part").agg(F.collect_list(F.struct("conv_id", "before", "last")).alias("ends"))  # two per part at most

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, m = Reader(), cloudpickle.loads(shared.value)
        for part, table in by_part(batches):
            known = {e["conv_id"]: (e["before"], e["last"]) for e in table.column("ends")[0].as_py() or []}
            convs, texts = table.column("conv_id").to_pylist(), table.column("text").to_pylist()
            out: list[tuple] = []
            for a, b in _segments(convs):
                f, sizes = features(reader, texts[a:b])
                before, last = known.get(convs[a], (None, None))
                states = m.path(m.scores(f), before, last)
                at = 0
                for text, size in zip(texts[a:b], sizes):
                    out.append(_rendered(reader.lines(text), states[at:at + size]))
                    at += size
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([
                table.column("conv_id").combine_chunks(), table.column("turn").combine_chunks(), pa.array(columns[0], pa.string()),
                pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                ["conv_id", "turn", "role_pred", "line_roles", "n_lines", "rendered"])

    both = narrow.join(borders, "part", "left").repartition(parts, "part")
    return both.mapInArrow(solve, "conv_id bigint, turn bigint, role_pred string, line_roles string, n_lines bigint, rendered string")


def _rendered(lines: list, states: np.ndarray) -> tuple[str, str, int, str]:
    marks, out = "", ""
    for (line, _), state in zip(lines, states.tolist()):
        role = ROLES[state % 3]
        marks += role[0].upper() if state < 3 else role[0]
        out += f"<|{role}|>\n" if state < 3 else "\n" * line.blank
        # only a marker that says what the state says is no text
        out += line.text[line.cut if state == line.role else 0:] + "\n"
    return ROLES[int(states[0]) % 3], marks, len(lines), out


def held_out(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.crc32(F.col(conv_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chat_roles(turns: DataFrame) -> DataFrame:
    """``parsed`` with ``held_out``; learns from the conversations that aren't held out. An empty table gives an empty result."""
    model = learn(turns.where(~held_out()))
    return parsed(turns, model).withColumn("held_out", held_out())
