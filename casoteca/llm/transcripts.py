"""Chat transcripts: roles of raw lines by a hidden Markov model, then canonical turns.

The hidden state of a line is a role and whether the line opens a turn. What is seen of a
line is its speaker marker, its length and whether it ends like a question. The model's
counts come from labelled conversations. Long conversations are decoded in blocks: each
block becomes a matrix of best scores between the states around it, the matrices of a
conversation give the states at the block borders, and every block is then
decoded between its own. The result is the Viterbi path of the whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
STATES = len(ROLES) * 2            # role * 2 + (0 opens a turn, 1 goes on)
#: Turn numbers that a block holds.
BLOCK_TURNS = 64
#: Speaker names that raw transcripts use for each role.
SPEAKERS = {"system": ("system", "instructions"), "user": ("user", "human", "you", "q"),
            "assistant": ("assistant", "ai", "bot", "a")}
_OF = {name: i for i, role in enumerate(ROLES) for name in SPEAKERS[role]}
_MARK = re.compile(r"^\s*(?:[#>*\[(<|-]+\s*)?([A-Za-z]{1,14})\s*(?:[|>\])*]+\s*:?|:)\s*")
#: Markers 0-2: a role's name, 3: another name, 4: none; 4 lengths; question or not.
SYMBOLS = 5 * 4 * 2


def split_marker(line: str) -> tuple[int, str]:
    """The marker's class, and the line without a marker that names a role."""
    found = _MARK.match(line)
    if not found:
        return 4, line
    role = _OF.get(found[1].lower())
    return (3, line) if role is None else (role, line[found.end():])


def symbol(line: str) -> int:
    marker, rest = split_marker(line)
    length = 0 if not rest.strip() else 1 if len(rest) < 60 else 2 if len(rest) < 300 else 3
    return (marker * 4 + length) * 2 + rest.rstrip().endswith("?")


def _symbols(turns: DataFrame) -> DataFrame:
    """One row per turn row: conv, turn, seq, symbols of its lines, lines, role number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [(t or "").split("\n") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["conv"], batch["turn"], batch["role"],
                 pa.array([[symbol(x) for x in y] for y in lines], pa.list_(pa.int32())),
                 pa.array(lines, pa.list_(pa.string()))], ["conv", "turn", "role", "symbols", "lines"])

    return turns.mapInArrow(run, "conv long, turn long, role int, symbols array<int>, lines array<string>")


def raw_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """Turns as a raw transcript shows them: marker styles differ, and a fifth have no marker.

    Unknown and NULL roles count as user. The style is a hash of the conversation, so a
    transcript is consistent; which markers are lost is a hash of the turn.
    """
    number = F.coalesce(*(F.when(F.lower(role) == r, F.lit(i)) for i, r in enumerate(ROLES)), F.lit(1))
    style = F.pmod(F.xxhash64(conv), F.lit(4))
    name = F.element_at(F.array(*(F.array(*(F.lit(SPEAKERS[r][k % len(SPEAKERS[r])]) for k in range(4)))
                                  for r in ROLES)), F.col("number") + 1)
    shown = F.element_at(name, (style + 1).cast("int"))
    marker = F.when(F.pmod(F.xxhash64(conv, turn), F.lit(5)) == 0, F.lit("")) \
        .when(style == 0, F.concat(F.initcap(shown), F.lit(": "))) \
        .when(style == 1, F.concat(F.lit("### "), F.initcap(shown), F.lit(": "))) \
        .when(style == 2, F.concat(F.lit("["), shown, F.lit("] "))) \
        .otherwise(F.concat(F.lit("<|"), shown, F.lit("|> ")))
    return conversations.withColumn("number", number).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.col("number").cast("int").alias("role"), F.concat(marker, F.coalesce(F.col(text), F.lit(""))).alias("text"))


class Model:
    """Log probabilities with one added to every count."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        normal = lambda x: np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))
        self.start, self.step, self.emit = normal(start), normal(step), normal(emit)
        inside = np.arange(STATES) % 2 == 1
        self.start[inside] = -1e9                       # a transcript opens with a turn
        for s in range(STATES):                         # a line that goes on keeps its role
            self.step[s, inside & (np.arange(STATES) // 2 != s // 2)] = -1e9


def train(turns: DataFrame) -> Model:
    """Counts of states, steps and symbols over all labelled turns (``raw_turns``)."""
    seen = _symbols(turns)
    inner = seen.select("role", F.posexplode("symbols").alias("at", "symbol")) \
        .groupBy(F.col("role").alias("r"), F.least("at", F.lit(2)).alias("at"), "symbol").count().collect()
    emit, step, start = np.zeros((STATES, SYMBOLS)), np.zeros((STATES, STATES)), np.zeros(STATES)
    for r, at, s, n in inner:
        emit[2 * r + (at > 0), s] += n
        if at:
            step[2 * r + (at > 1), 2 * r + 1] += n
    before = seen.select("conv", "turn", "role", (F.size("symbols") > 1).alias("long"))
    after = before.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    for r, long, nxt, n in before.join(after, ["conv", "turn"]).groupBy("role", "long", "next").count().collect():
        step[2 * r + int(long), 2 * nxt] += n
    for r, n in before.where("turn = 0").groupBy("role").count().collect():
        start[2 * r] += n
    return Model(start, step, emit)


def block_matrix(model: Model, symbols: list[int]) -> np.ndarray:
    """Best score from each state before the lines, and in the last row from the start, to each at their end."""
    best = np.concatenate((model.step, model.start[None])) + model.emit[:, symbols[0]]
    for s in symbols[1:]:
        best = (best[:, :, None] + model.step[None]).max(axis=1) + model.emit[:, s]
    return best


def decode(model: Model, symbols: list[int], entry: int, leave: int) -> list[int]:
    """The best states between a state before (-1: the start) and one at the end (-1: the best)."""
    if not symbols:
        return []
    score = (model.start if entry < 0 else model.step[entry]) + model.emit[:, symbols[0]]
    back = []
    for s in symbols[1:]:
        ways = score[:, None] + model.step
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + model.emit[:, s]
    path = [int(score.argmax()) if leave < 0 else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def parse(turns: DataFrame, model: Model) -> DataFrame:
    """Recovered turns of raw transcripts.

    ``turns`` has conv, turn (order of its stretches of lines), role (of which only the
    check column is made) and text. Returns a row per block and recovered turn:
    conv, block, position, role, text (the canonical turn without its marker),
    opens (false: it goes on from the block before), n_lines, n_right (lines whose
    role is the given one). Rows with a NULL conversation or turn come first, as
    one conversation or turn; repeated turns follow one another, ordered by text.
    """
    block = F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS).alias("block")
    blocks = _symbols(turns).groupBy("conv", block).agg(F.sort_array(F.collect_list(
        F.struct("turn", "lines", "symbols", "role"))).alias("turns"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_matrix(model, [s for t in row for s in t]).ravel().tolist()
                     for row in batch["symbols"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["block"], pa.array(found, pa.list_(pa.float64()))],
                                             ["conv", "block", "scores"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, out = batch["conv"].to_pylist(), []
            for c, rows in zip(conv, batch["rows"].to_pylist()):
                states = _borders([np.array(row["scores"]).reshape(-1, STATES) for row in rows])
                out.extend((c, row["block"], a, b) for row, (a, b) in zip(rows, states))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                ["conv", "block", "entry", "leave"])

    several = blocks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    parts_ = blocks.join(several, blocks["conv"].eqNullSafe(several["conv"]), "left_semi") \
        .select("conv", "block", F.col("turns.symbols").alias("symbols")) \
        .mapInArrow(measure, "conv long, block long, scores array<double>")
    ends = parts_.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "scores"))).alias("rows")) \
        .mapInArrow(borders, "conv long, block long, entry int, leave int") \
        .select(F.col("conv").alias("c"), F.col("block").alias("b"), "entry", "leave")
    ready = blocks.join(ends, blocks["conv"].eqNullSafe(ends["c"]) & (blocks["block"] == ends["b"]), "left") \
        .select("conv", "block", "turns", F.coalesce("entry", F.lit(-1)).alias("entry"),
                F.coalesce("leave", F.lit(-1)).alias("leave"))

    def recover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, block, turns, entry, leave in zip(*(batch[c].to_pylist() for c in (
                    "conv", "block", "turns", "entry", "leave"))):
                lines = [(x, t["role"]) for t in turns for x in t["lines"]]
                path = decode(model, [s for t in turns for s in t["symbols"]], entry, leave)
                position = -1
                for (line, true), state in zip(lines, path):
                    if position < 0 or state % 2 == 0:
                        position += 1
                        out.append([conv, block, position, state // 2, [], state % 2 == 0, 0])
                    out[-1][4].append(split_marker(line)[1] if state % 2 == 0 else line)
                    out[-1][6] += state // 2 == true
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.int32()), pa.array([ROLES[o[3]] for o in out], pa.string()),
                 pa.array(["\n".join(o[4]) for o in out], pa.string()), pa.array([o[5] for o in out], pa.bool_()),
                 pa.array([len(o[4]) for o in out], pa.int64()), pa.array([o[6] for o in out], pa.int64())],
                ["conv", "block", "position", "role", "text", "opens", "n_lines", "n_right"])

    return ready.mapInArrow(recover, "conv long, block long, position int, role string, text string, "
                                     "opens boolean, n_lines long, n_right long")


def _borders(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """States before and at the end of each block of one conversation, -1 before the first."""
    score, back = matrices[0][-1], []
    for m in matrices[1:]:
        ways = score[:, None] + m[:-1]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path = path[::-1]
    return [(-1 if i == 0 else path[i - 1], path[i]) for i in range(len(path))]


def canonical(turns: DataFrame) -> DataFrame:
    """The rendering of each recovered turn: a role header before turns that open."""
    return turns.withColumn("rendered", F.concat(
        F.when(F.col("opens"), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise(F.lit("")),
        "text", F.lit("\n")))


def summary(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, n_lines, n_right, n_chars and a digest of what is rendered."""
    return canonical(turns).groupBy(F.col("conv").alias("conv_id")).agg(
        F.sum(F.col("opens").cast("long")).alias("n_turns"), F.sum("n_lines").alias("n_lines"),
        F.sum("n_right").alias("n_right"), F.sum(F.length("rendered").cast("long")).alias("n_chars"),
        F.sum(F.crc32(F.concat_ws("/", "block", "position", "rendered"))).alias("digest"))
