"""Secret scans: all rules in one deterministic automaton over bytes.

Every rule's expression becomes a position automaton, its subsets become the states of a
leftmost-longest scanner of that rule, and the scanners of all rules are combined and minimised into
one transition array. A pass over the bytes reports where matches end, whichever rule they belong to.
Starts, which are needed for few bytes only, come from the subsets of the reversed expression.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casoteca.llm.text import PART_BYTES, parts, text_bytes

#: Ends a text in a scanned stream; UTF-8 has no such byte, and no rule may contain it.
END = 0xFF
#: States of the combined scanner up to which rules are accepted.
MAX_STATES = 1 << 16
#: Bytes of a lane; all lanes of a part of a batch advance together.
LANE = 512


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``prefix`` then ``body``, of which ``least`` bytes or more must be there.

    Expressions are ASCII: characters, ``\\xHH`` and escaped characters, ``[...]`` with ranges, groups,
    ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``. Matches are leftmost, longest and do
    not overlap within a kind; too short ones are dropped afterwards, as if a plain expression had found them.
    """

    kind: str
    prefix: str
    body: str
    least: int = 0
    any_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
         "[A-Za-z0-9+/_.=-]+", 8, any_case=True),
    Rule("access", "", "AKIA[A-Z0-9]+", 16),
    # thirty-two or more are asked for by the automaton itself, as short runs are everywhere
    Rule("hex", "", "[0-9a-f]{32,}"),
)
ADDED = (
    Rule("private_key", "", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
RULES = BASE + ADDED


def parse(expression: str, any_case: bool = False) -> tuple:
    """A tree of ("set", bytes), ("cat", trees), ("alt", trees) and ("rep", tree, least, most)."""
    at = 0

    def fail(why: str) -> ValueError:
        return ValueError(f"{why} at {at} in {expression!r}")

    def peek() -> str:
        return expression[at:at + 1]

    def take(n: int = 1) -> str:
        nonlocal at
        at += n
        if at > len(expression):
            raise fail("unexpected end")
        return expression[at - n:at]

    def char() -> int:
        c = take()
        if c == "\\":
            c = take()
            if c == "x":
                return int(take(2), 16)
            if c.isalnum():
                raise fail("unknown escape")
        return ord(c)

    def leaf(values: set[int]) -> tuple:
        if any_case:
            values = {ord(x) for v in values for x in (chr(v).lower(), chr(v).upper())}
        if max(values, default=0x80) >= 0x80:
            raise fail("not ASCII")
        return "set", frozenset(values)

    def one_of() -> tuple:
        values: set[int] = set()
        if peek() == "^":
            raise fail("negated set")
        while peek() != "]":
            low = high = char()
            if peek() == "-" and expression[at + 1:at + 2] != "]":
                take()
                high = char()
            values |= set(range(low, high + 1))
        take()
        return leaf(values)

    def atom() -> tuple:
        c = peek()
        if c == "(":
            take()
            inner = either()
            if take() != ")":
                raise fail("no closing parenthesis")
            return inner
        if c == "[":
            take()
            return one_of()
        if c in "?*+{.^$":
            raise fail("unsupported")
        return leaf({char()})

    def times(tree: tuple) -> tuple:
        while peek() and peek() in "?*+{":
            c = take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                until = expression.find("}", at)
                if until < 0:
                    raise fail("no closing brace")
                first, comma, last = take(until - at + 1)[:-1].partition(",")
                low = int(first)
                high = (int(last) if last else None) if comma else low
            tree = "rep", tree, low, high
        return tree

    def both() -> tuple:
        trees = []
        while peek() and peek() not in "|)":
            trees.append(times(atom()))
        return "cat", trees

    def either() -> tuple:
        trees = [both()]
        while peek() == "|":
            take()
            trees.append(both())
        return ("alt", trees) if len(trees) > 1 else trees[0]

    tree = either()
    if at < len(expression):
        raise fail("unexpected character")
    return tree


@dataclass
class Positions:
    """The position automaton of a tree: one position for each set, no empty moves."""

    sets: list[frozenset[int]] = field(default_factory=list)
    follow: list[set[int]] = field(default_factory=list)
    first: set[int] = field(default_factory=set)
    last: set[int] = field(default_factory=set)
    empty: bool = False

    @classmethod
    def of(cls, tree: tuple) -> Positions:
        out = cls()
        out.empty, out.first, out.last = out._add(tree)
        return out

    def _add(self, tree: tuple) -> tuple[bool, set[int], set[int]]:
        kind = tree[0]
        if kind == "set":
            self.sets.append(tree[1])
            self.follow.append(set())
            return False, {len(self.sets) - 1}, {len(self.sets) - 1}
        if kind == "alt":
            made = [self._add(t) for t in tree[1]]
            return any(m[0] for m in made), set().union(*(m[1] for m in made)), set().union(*(m[2] for m in made))
        if kind == "cat":
            made = [self._add(t) for t in tree[1]]
        else:
            _, inner, low, high = tree
            made = [self._add(inner) for _ in range(max(low, 1) if high is None else high)]
            made = [(empty or i >= low, first, last) for i, (empty, first, last) in enumerate(made)]
            if high is None:
                for p in made[-1][2]:
                    self.follow[p] |= made[-1][1]
        empty, first, last = True, set(), set()
        for e, f, l in made:
            for p in last:
                self.follow[p] |= f
            if empty:
                first = first | f
            last = l | (last if e else set())
            empty = empty and e
        return empty, first, last

    def step(self, live: frozenset[int] | None, byte: int) -> frozenset[int]:
        """Positions after one more byte; ``None`` is the beginning."""
        after = self.first if live is None else set().union(*(self.follow[p] for p in live)) if live else set()
        return frozenset(q for q in after if byte in self.sets[q])

    def reverse(self) -> Positions:
        back: list[set[int]] = [set() for _ in self.follow]
        for p, after in enumerate(self.follow):
            for q in after:
                back[q].add(p)
        return Positions(self.sets, back, self.last, self.first, self.empty)


def subsets(start: Hashable, step: Callable[[Hashable, int], Hashable],
            symbols: range | list[int], limit: int = MAX_STATES) -> tuple[list, list[list[int]]]:
    """All states reached from ``start``, which is state 0, and the next state for every symbol."""
    states, number, table = [start], {start: 0}, []
    while len(table) < len(states):
        row = []
        for symbol in symbols:
            to = step(states[len(table)], symbol)
            if to not in number:
                if len(states) >= limit:
                    raise ValueError(f"the rules need more than {limit} states")
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        table.append(row)
    return states, table


def minimise(table: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest table that gives the same labels for every input; state 0 stays state 0."""
    group = np.unique(label, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack((group, group[table])), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keep = first[order]
    return rank[group][table[keep]], label[keep]


class Scanner:
    """The leftmost-longest scanner of one rule: its states say whether a match ended before this byte.

    A state holds the positions of each start that may still match, earliest start first. A match must
    be recognised while it is read: an expression for which one would have to look further before an
    earlier end or a later start is certain is refused.
    """

    def __init__(self, rule: Rule):
        self.rule = rule
        self.forward = Positions.of(parse(rule.prefix + rule.body, rule.any_case))
        if self.forward.empty:
            raise ValueError(f"{rule.kind} matches empty text")
        self.head = Positions.of(parse(rule.prefix, rule.any_case))

    def _full(self, live: frozenset[int]) -> bool:
        return not self.forward.last.isdisjoint(live)

    def step(self, state: tuple, byte: int) -> tuple:
        before, ended = state[0], False
        if before and self._full(before[0]):
            on = self.forward.step(before[0], byte)
            if on and not self._full(on):
                raise ValueError(f"{self.rule.kind}: the end of a match is not certain where it is read")
            if on:
                return (on,), False
            before, ended = (), True
        after, seen = [], set()
        for live in (*before, None):
            on = frozenset(self.forward.step(live, byte) - seen)
            seen |= on
            if on:
                after.append(on)
        for i, live in enumerate(after):
            if self._full(live):
                if i:
                    raise ValueError(f"{self.rule.kind}: a match may lie inside the beginning of another")
                after = [live]
                break
        return tuple(after), ended


@dataclass(frozen=True)
class Automaton:
    """Transition arrays for all rules; states are numbered in steps of ``width``."""

    rules: tuple[Rule, ...]
    width: int
    classes: np.ndarray
    table: np.ndarray
    ended: np.ndarray
    backward: tuple[tuple[list[list[int]], list[bool]], ...]
    heads: tuple[tuple[list[list[int]], list[bool]], ...]

    def run(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where matches end in a stream of texts, each followed by ``END``, and the rules as bits.

        The stream is cut into lanes that advance together from the first state. A lane whose
        predecessor stops in another state is run again from there, until both runs agree.
        """
        lanes = max(1, -(-len(stream) // LANE))
        padded = np.full(lanes * LANE, END, np.uint8)
        padded[:len(stream)] = stream
        symbol = np.ascontiguousarray(self.classes[padded].reshape(lanes, LANE).T)
        seen = np.empty((LANE, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        place = np.empty(lanes, np.int64)
        for k in range(LANE):
            np.add(state, symbol[k], out=place)
            np.take(self.table, place, out=state)
            seen[k] = state
        begin = np.zeros(lanes, np.int32)
        while True:
            due = np.concatenate((np.zeros(1, np.int32), seen[-1, :-1]))
            again = np.flatnonzero(due != begin)
            if not len(again):
                break
            if len(again) <= 4:
                self._walk(int(again[0]), due, begin, symbol, seen)
                continue
            begin[again] = due[again]
            now = due[again]
            for k in range(LANE):
                now = self.table[now.astype(np.int64) + symbol[k, again]]
                other = now != seen[k, again]
                again, now = again[other], now[other]
                if not len(again):
                    break
                seen[k, again] = now
        bits = self.ended[seen.T.ravel()]
        where = np.flatnonzero(bits)
        return where, bits[where]

    def _walk(self, lane: int, due: np.ndarray, begin: np.ndarray, symbol: np.ndarray, seen: np.ndarray) -> None:
        """One lane, and those after it, byte by byte until the state is the one seen before."""
        state, table = int(due[lane]), self.table
        while lane < symbol.shape[1]:
            begin[lane] = state
            row, old = symbol[:, lane].tolist(), seen[:, lane].tolist()
            for k in range(LANE):
                state = int(table[state + row[k]])
                if state == old[k]:
                    break
                old[k] = state
            else:
                seen[:, lane] = old
                lane += 1
                continue
            seen[:, lane] = old
            return

    def start(self, rule: int, data: bytes, low: int, end: int) -> int:
        """The leftmost place from which the rule matches up to ``end``, not before ``low``."""
        table, full = self.backward[rule]
        state, best = 0, end
        for at in range(end - 1, low - 1, -1):
            state = table[state][data[at]]
            if state < 0:
                break
            if full[state]:
                best = at
        return best

    def body(self, rule: int, data: bytes, start: int, end: int) -> int:
        """Where the body of a match begins: after the longest prefix."""
        table, full = self.heads[rule]
        state, best = 0, start
        for at in range(start, end):
            state = table[state][data[at]]
            if state < 0:
                break
            if full[state]:
                best = at + 1
        return best

    def matches(self, stream: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, start, end, rule) with offsets in the stream; ``limits``: where each text begins."""
        where, bits = self.run(stream)
        if not len(where):
            return
        data = stream.tobytes()
        owner = np.searchsorted(limits, where, side="right") - 1
        done = [0] * len(self.rules)
        for at, mask, text in zip(where.tolist(), bits.tolist(), owner.tolist()):
            for r, rule in enumerate(self.rules):
                if mask >> r & 1:
                    start = self.start(r, data, max(done[r], int(limits[text])), at)
                    done[r] = at
                    if at - self.body(r, data, start, at) >= rule.least:
                        yield text, start, at, r


def _anchored(positions: Positions) -> tuple[list[list[int]], list[bool]]:
    """The subset automaton of an anchored match as lists; -1 is a dead end."""
    states, table = subsets(None, positions.step, range(256))
    dead = {i for i, s in enumerate(states) if s is not None and not s}
    full = [s is not None and not positions.last.isdisjoint(s) for s in states]
    return [[-1 if to in dead else to for to in row] for row in table], full


@lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """Subset construction for every rule, their product, and its minimisation."""
    if len({r.kind for r in rules}) < len(rules) or len(rules) > 31:
        raise ValueError("up to 31 rules with different kinds")
    scanners = [Scanner(r) for r in rules]
    every = [s for scanner in scanners for s in scanner.forward.sets]
    signs = np.array([[b in s for s in every] for b in range(256)], bool).reshape(256, -1)
    example, classes = np.unique(np.packbits(signs, axis=1), axis=0, return_index=True, return_inverse=True)[1:]
    tables, labels = [], []
    for scanner in scanners:
        states, table = subsets(((), False), scanner.step, example.tolist())
        table, label = minimise(np.array(table), np.array([s[1] for s in states], np.int64))
        tables.append(table.tolist())
        labels.append(label.tolist())
    states, table = subsets((0,) * len(rules),
                            lambda s, c: tuple(t[x][c] for t, x in zip(tables, s)), range(len(example)))
    bits = np.array([sum(label[x] << r for r, (label, x) in enumerate(zip(labels, s))) for s in states])
    table, bits = minimise(np.array(table), bits)
    width = len(example)
    return Automaton(rules, width, classes.ravel().astype(np.uint8), (table * width).astype(np.int32).ravel(),
                     np.repeat(bits, width).astype(np.int32),
                     tuple(_anchored(s.forward.reverse()) for s in scanners),
                     tuple(_anchored(s.head) for s in scanners))


def joined(matches: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """kind:start:end, by start and then by kind as listed, comma-joined."""
    return ",".join(f"{kinds[r]}:{a}:{b}" for a, r, b in sorted((a, r, b) for a, b, r in matches))


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of secrets in every whole text.

    Returns per row: the id, ``n_<kind>`` for each base rule, base_sha256 (of the spans of base rules), spans
    (of all rules); spans are kind:start:end in code points, end exclusive, by start and then by kind as
    listed, comma-joined. NULL and empty texts have none. Rows with equal or no ids are scanned like others;
    other columns are not looked at. A text of any length is scanned whole, in one task.
    """
    automaton = compile_rules(tuple(rules))
    kinds = [r.kind for r in rules]
    basic = [kinds.index(r.kind) for r in base]
    names = [f"n_{kinds[r]}" for r in basic]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, size=PART_BYTES):
            data, offsets = text_bytes(part["text"])
            limits = offsets + np.arange(len(offsets))
            stream = np.insert(data, offsets[1:], END)
            counts = np.zeros((len(names), part.num_rows), np.int64)
            digest, spans = [nothing] * part.num_rows, [""] * part.num_rows
            found: dict[int, list[tuple[int, int, int]]] = {}
            for text, a, b, r in automaton.matches(stream, limits):
                found.setdefault(text, []).append((a, b, r))
            for text, mine in found.items():
                begin = int(limits[text])
                chars = np.concatenate(([0], np.cumsum((stream[begin:limits[text + 1]] & 0xC0) != 0x80)))
                mine = [(int(chars[a - begin]), int(chars[b - begin]), r) for a, b, r in mine]
                spans[text] = joined(mine, kinds)
                digest[text] = hashlib.sha256(joined([m for m in mine if m[2] in basic], kinds).encode()).hexdigest()
                for i, r in enumerate(basic):
                    counts[i, text] = sum(m[2] == r for m in mine)
            yield pa.RecordBatch.from_arrays(
                [part["id"], *map(pa.array, counts), pa.array(digest), pa.array(spans)],
                [id_column, *names, "base_sha256", "spans"])

    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` long, " + ", ".join(f"{n} long" for n in names)
                           + ", base_sha256 string, spans string")
