"""Regular expressions over bytes compiled into one deterministic automaton.

Rules become one nondeterministic automaton, subset construction makes it
deterministic over classes of bytes, partition refinement minimises it, and the
result is a flat transition array. Supported: literals, escapes (\\xHH, \\d, \\w,
\\s and escaped symbols), classes with ranges and negation, groups, |, *, +, ?,
{m}, {m,} and {m,n}. Nothing else is needed by the rules and anything else is
refused."""

from __future__ import annotations

from collections.abc import Sequence

_DIGIT = frozenset(range(0x30, 0x3A))
_WORD = _DIGIT | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | {0x5F}
_SPACE = frozenset([0x20, *range(0x09, 0x0E)])
_ANY = frozenset(range(256))
_NAMED = {"d": _DIGIT, "w": _WORD, "s": _SPACE, "n": frozenset([10]), "r": frozenset([13]), "t": frozenset([9])}


class _Nfa:
    """States with byte edges and empty edges; fragments are (start, end)."""

    def __init__(self, fold: bool = False):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        self.fold = fold

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    # Reading: alternatives of sequences of repeated atoms.
    def read(self, source: str) -> tuple[int, int]:
        self.source, self.at = source, 0
        part = self._either()
        if self.at != len(source):
            raise ValueError(f"unread rest {source[self.at:]!r}")
        return part

    def _peek(self) -> str:
        return self.source[self.at : self.at + 1]

    def _either(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        start, end = self.state(), self.state()
        for a, b in parts:
            self.empty[start].append(a)
            self.empty[b].append(end)
        return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            a, b = self._repeated()
            self.empty[end].append(a)
            end = b
        return start, end

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        part = self._atom()
        stop = self.at
        low, high = self._bounds()
        if (low, high) == (1, 1):
            return part
        after = self.at
        start = end = self.state()
        for i in range(max(low, 1) if high is None else high):
            if i:
                self.at = begin
                part = self._atom()
                assert self.at == stop
            if i >= low:
                self.empty[part[0]].append(part[1])
            self.empty[end].append(part[0])
            end = part[1]
        if high is None:
            # The last copy repeats; a fresh end keeps loops inside the fragment.
            self.empty[end].append(part[0])
            if low == 0:
                self.empty[part[0]].append(end)
            last = self.state()
            self.empty[end].append(last)
            end = last
        self.at = after
        return start, end

    def _bounds(self) -> tuple[int, int | None]:
        c = self._peek()
        if c and c in "*+?":
            self.at += 1
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if c == "{":
            stop = self.source.index("}", self.at)
            low, comma, high = self.source[self.at + 1 : stop].partition(",")
            self.at = stop + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            self.at += 1
            if self.source.startswith("?:", self.at):
                self.at += 2
            part = self._either()
            if self._peek() != ")":
                raise ValueError("unclosed group")
            self.at += 1
            return part
        if c in ("", *"^$*+?{"):
            raise ValueError(f"{c!r} at {self.at} of {self.source!r}")
        if c == "[":
            chars = self._class()
        elif c == ".":
            self.at += 1
            chars = _ANY - {10}
        else:
            chars = self._char()
        if self.fold:
            chars = chars | {b ^ 0x20 for b in chars if chr(b).isascii() and chr(b).isalpha()}
        start, end = self.state(), self.state()
        self.edges[start].append((frozenset(chars), end))
        return start, end

    def _char(self) -> frozenset[int]:
        c = self.source[self.at]
        self.at += 1
        if c == "\\":
            c = self.source[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return frozenset([int(self.source[self.at - 2 : self.at], 16)])
            if c in _NAMED:
                return _NAMED[c]
            if c.isalnum():
                raise ValueError(f"escape \\{c}")
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return frozenset([ord(c)])

    def _class(self) -> frozenset[int]:
        self.at += 1
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        first = True
        while first or self._peek() != "]":
            first = False
            low = self._char()
            if self._peek() == "-" and self.source[self.at + 1] != "]":
                self.at += 1
                found.update(range(min(low), min(self._char()) + 1))
            else:
                found |= low
        self.at += 1
        return _ANY - found if negated else frozenset(found)


class Dfa:
    """`table[state + byte]` is the next state; states are multiples of 256.
    States below `accepting` accept, `rules` names what; `start` is the state
    before any byte, `dead` (or -1) the state that nothing leaves."""

    def __init__(self, patterns: Sequence[tuple[str, bool]], search: bool):
        """Patterns are (expression, either case). With `search`, matches may
        begin anywhere: the start stays alive."""
        nfa = _Nfa()
        root = nfa.state()
        ends: dict[int, int] = {}
        for rule, (source, fold) in enumerate(patterns):
            nfa.fold = fold
            a, b = nfa.read(source)
            nfa.empty[root].append(a)
            ends[b] = rule
        self._build(nfa, root, ends, search)

    def _build(self, nfa: _Nfa, root: int, ends: dict[int, int], search: bool) -> None:
        closures: dict[int, frozenset[int]] = {}

        def closure(s: int) -> frozenset[int]:
            if s not in closures:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.empty[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closures[s] = frozenset(t for t in seen if nfa.edges[t] or t in ends)
            return closures[s]

        # Bytes that no edge tells apart share a class.
        marks: dict[tuple, int] = {}
        kinds = sorted({e[0] for es in nfa.edges for e in es}, key=sorted)
        of_byte = [marks.setdefault(tuple(b in k for k in kinds), len(marks)) for b in range(256)]
        sample = {c: of_byte.index(c) for c in range(len(marks))}

        begin = closure(root)
        numbers = {begin: 0}
        sets = [begin]
        rows: list[list[int]] = []
        step: dict[tuple[int, int], frozenset[int]] = {}
        for now in sets:
            row = []
            for c in range(len(marks)):
                after: set[int] = set(begin) if search else set()
                for s in now:
                    if (s, c) not in step:
                        out: set[int] = set()
                        for chars, t in nfa.edges[s]:
                            if sample[c] in chars:
                                out |= closure(t)
                        step[s, c] = frozenset(out)
                    after |= step[s, c]
                key = frozenset(after)
                if key not in numbers:
                    numbers[key] = len(sets)
                    sets.append(key)
                row.append(numbers[key])
            rows.append(row)
        accepted = [frozenset(ends[s] for s in x if s in ends) for x in sets]
        self._minimise(rows, accepted, of_byte)

    def _minimise(self, rows, accepted, of_byte) -> None:
        """Blocks of states are split until equal states agree on every class."""
        first: dict = {}
        block = [first.setdefault(a, len(first)) for a in accepted]
        count = len(first)
        while True:
            seen: dict = {}
            block = [
                seen.setdefault((block[i], *[block[t] for t in row]), len(seen)) for i, row in enumerate(rows)
            ]
            if len(seen) == count:
                break
            count = len(seen)
        member = {}
        for i, b in enumerate(block):
            member.setdefault(b, i)
        order = sorted(member, key=lambda b: (not accepted[member[b]], b))
        place = {b: 256 * i for i, b in enumerate(order)}
        self.accepting = 256 * sum(bool(accepted[member[b]]) for b in order)
        self.rules = {place[b]: accepted[member[b]] for b in order if accepted[member[b]]}
        self.start = place[block[0]]
        self.table: list[int] = []
        self.dead = -1
        for b in order:
            row = rows[member[b]]
            self.table += [place[block[row[c]]] for c in of_byte]
            if not accepted[member[b]] and all(block[t] == b for t in row):
                self.dead = place[b]

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at `at`, or -1."""
        table, accepting, dead, s, end = self.table, self.accepting, self.dead, self.start, -1
        if s < accepting:
            end = at
        for i in range(at, len(data)):
            s = table[s + data[i]]
            if s < accepting:
                end = i + 1
            elif s == dead:
                break
        return end
