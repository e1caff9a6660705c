"""A generalised LL recogniser with a graph-structured stack, over token kinds, for any context-free grammar.

A grammar is text: `Name = a 'b' C? (D | E)* @{F} ;`. Quoted words and names in capitals are token kinds, other names are rules.
`@{F}`, `@(F)`, `@[F]` and `@F` followed by `#` are groups: a bracketed part of the source, folded into one token, whose content derives F. Because
brackets match in every derivation, parsing contents first and then what holds them accepts the same language as one parse of all, while
contents and statements, of which a corpus has few shapes, are recognised once for each shape.
"""

from __future__ import annotations

import re

#: Flag of a token that begins a line, for grammars in which a line end may end a statement.
NEWLINE = 1 << 28
#: Kinds from here on are groups: bracket in the low two bits, above them a bit for each rule that the content derives.
GROUP = 1 << 29
BRACKETS = "([{#"
MEMO = 400_000

_TOKEN = re.compile(r"\s*(?:'([^']+)'|@([({\[#])\s*(\w+)\s*[)}\]#]|(\w+)|([=|;()*+?~]))")


class Grammar:
    """Rules compiled to slots. `reserved` are words that are no identifiers."""

    def __init__(self, text: str, reserved: str, identifier: str = "ID"):
        self.reserved = frozenset(reserved.split())
        self.rules: dict[str, list[list]] = {}
        self._fresh = 0
        toks = [m.groups() for m in _TOKEN.finditer(text)]
        defined = {toks[i][3] for i in range(len(toks) - 1) if toks[i][3] and toks[i + 1][4] == "=" and (i == 0 or toks[i - 1][4] == ";")}
        self._toks, self._at, self._defined = toks, 0, defined
        while self._at < len(toks):
            name = toks[self._at][3]
            self._at += 2
            self.rules[name] = self._alternatives()
            self._at += 1
        self._compile(identifier)

    def _alternatives(self) -> list[list]:
        out, cur = [], []
        while self._at < len(self._toks):
            lit, bracket, inner, name, op = self._toks[self._at]
            if op in (";", ")"):
                break
            self._at += 1
            if op == "|":
                out.append(cur)
                cur = []
                continue
            if lit is not None:
                term = ("t", lit)
            elif bracket:
                term = ("g", (bracket, inner))
            elif name:
                term = ("n", name) if name in self._defined else ("t", name)
            elif op == "~":  # a line end, or the end
                term = ("z", None)
            else:  # "("
                term = ("n", self._rule(self._alternatives()))
                self._at += 1
            while self._at < len(self._toks) and self._toks[self._at][4] in ("?", "*", "+") and self._toks[self._at][4]:
                q = self._toks[self._at][4]
                self._at += 1
                if q == "?":
                    term = ("n", self._rule([[term], []]))
                else:
                    rest = f"_{self._fresh}"
                    self._fresh += 1
                    self.rules[rest] = [[("n", rest), term], []]  # left recursion: one stack node for all repetitions
                    term = ("n", rest) if q == "*" else ("n", self._rule([[("n", rest), term]]))
            cur.append(term)
        out.append(cur)
        return out

    def _rule(self, alts: list[list]) -> str:
        name = f"_{self._fresh}"
        self._fresh += 1
        self.rules[name] = alts
        return name

    def _compile(self, identifier: str) -> None:
        self.terminals: dict = {}
        for alts in self.rules.values():
            for alt in alts:
                for kind, x in alt:
                    if kind in "tg":
                        self.terminals.setdefault((kind, x), len(self.terminals))
        self.kinds: dict[str, int] = {}
        for kind, x in self.terminals:
            if kind == "t":
                self.kinds.setdefault(x, len(self.kinds))
        self.identifier = self.kinds.setdefault(identifier, len(self.kinds))
        self.contents = {b: sorted({x[1] for k, x in self.terminals if k == "g" and x[0] == b}) for b in BRACKETS}
        bit = {k: 1 << i for k, i in self.terminals.items()}
        own = bit.get(("t", identifier), 0)
        self.match: dict[int, int] = {}
        for word, code in self.kinds.items():
            soft = own if word not in self.reserved and re.fullmatch(r"[^\W\d]\w*", word) and word.islower() else 0
            self.match[code] = bit.get(("t", word), 0) | soft
        self._bit = bit
        names = {n: i for i, n in enumerate(self.rules)}
        self.number = names
        nullable: set[str] = set()
        while True:
            more = {n for n, alts in self.rules.items() if n not in nullable and any(all(k == "z" or k == "n" and x in nullable for k, x in a) for a in alts)}
            if not more:
                break
            nullable |= more
        first = {n: 0 for n in self.rules}

        def first_of(alt: list) -> tuple[int, bool]:
            mask = 0
            for k, x in alt:
                if k == "z":
                    continue
                if k != "n":
                    return mask | bit[k, x], False
                mask |= first[x]
                if x not in nullable:
                    return mask, False
            return mask, True

        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                new = first[n]
                for a in alts:
                    new |= first_of(a)[0]
                if new != first[n]:
                    first[n], changed = new, True
        self.first, self.last, self.within, self.nullable = first, self._ends(nullable, bit), self._reached(bit), nullable
        # A slot holds (0, bit) for a terminal, (1, rule, next slot) for a rule, (2,) for a possible line end, (3,) for the end of a rule.
        self.slots: list[tuple] = []
        self.entries: list[list[tuple[int, int, bool]]] = []
        for alts in self.rules.values():
            own_entries = []
            for a in alts:
                mask, null = first_of(a)
                own_entries.append((len(self.slots), mask, null))
                for k, x in a:
                    self.slots.append((2,) if k == "z" else (1, names[x], len(self.slots) + 1) if k == "n" else (0, bit[k, x]))
                self.slots.append((3,))
            self.entries.append(own_entries)
        self.memo: dict = {}
        self.masks: dict = {}

    def _ends(self, nullable: set[str], bit: dict) -> dict[str, int]:
        """The terminals that what a rule derives may end with."""
        last, changed = dict.fromkeys(self.rules, 0), True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                new = last[n]
                for alt in alts:
                    for k, x in reversed(alt):
                        if k != "z":
                            new |= last[x] if k == "n" else bit[k, x]
                            if k != "n" or x not in nullable:
                                break
                if new != last[n]:
                    last[n], changed = new, True
        return last

    def _reached(self, bit: dict) -> dict[str, int]:
        """The terminals that what a rule derives may hold."""
        out, changed = dict.fromkeys(self.rules, 0), True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                new = out[n]
                for alt in alts:
                    for k, x in alt:
                        if k != "z":
                            new |= out[x] if k == "n" else bit[k, x]
                if new != out[n]:
                    out[n], changed = new, True
        return out

    def derives(self, rule: str, kinds: tuple[int, ...]) -> bool:
        """Whether the rule derives the tokens. What a rule can't begin, end or hold is refused without a parse."""
        key = (rule, kinds)
        known = self.memo.get(key)
        if known is None:
            match = self.match
            bits = [match[k & ~NEWLINE] for k in kinds]
            if not bits:
                known = rule in self.nullable
            elif bits[0] & self.first[rule] and bits[-1] & self.last[rule]:
                within = self.within[rule]
                known = all([b & within for b in bits]) and self._recognise(self.number[rule], kinds, bits)
            else:
                known = False
            if len(kinds) <= 80:
                if len(self.memo) > MEMO:
                    self.memo.clear()
                self.memo[key] = known
        return known

    def _elements(self, content: tuple[int, ...]) -> list[tuple[int, ...]]:
        comma, out, start = self.kinds[","], [], 0
        for i, k in enumerate(content):
            if k & ~NEWLINE == comma:
                out.append(content[start:i])
                start = i + 1
        return [*out, content[start:]] if start < len(content) else out

    def _recognise(self, start: int, kinds: tuple[int, ...], bits: list[int]) -> bool:
        slots, entries = self.slots, self.entries
        bits.append(0)
        n = len(kinds)
        nodes: dict[tuple[int, int], tuple[list, list]] = {}  # (rule, place) -> (edges, ends)
        todo: list = []
        seen: set = set()

        def call(rule: int, at: int):
            node = ([], [])
            nodes[rule, at] = node
            look = bits[at]
            for slot, mask, null in entries[rule]:
                if null or look & mask:
                    todo.append((slot, node, at))
            return node

        root = call(start, 0)
        while todo:
            slot, node, at = todo.pop()
            while True:
                s = slots[slot]
                what = s[0]
                if what == 0:
                    if not bits[at] & s[1]:
                        break
                    at += 1
                    slot += 1
                elif what == 1:
                    rule, back = s[1], s[2]
                    callee = nodes.get((rule, at))
                    if callee is None:
                        callee = call(rule, at)
                        callee[0].append((back, node))
                    elif (back, id(node), id(callee)) not in seen:
                        seen.add((back, id(node), id(callee)))
                        callee[0].append((back, node))
                        for end in callee[1]:
                            key = (back, id(node), end)
                            if key not in seen:
                                seen.add(key)
                                todo.append((back, node, end))
                    break
                elif what == 2:
                    if at < n and not kinds[at] & NEWLINE:
                        break
                    slot += 1
                else:
                    ends = node[1]
                    if at in ends:
                        break
                    ends.append(at)
                    if node is root and at == n:
                        return True
                    for back, parent in node[0]:
                        key = (back, id(parent), at)
                        if key not in seen:
                            seen.add(key)
                            todo.append((back, parent, at))
                    break
        return n in root[1]

    def group(self, bracket: str, content: tuple[int, ...], sequences: dict, lists: dict = {}) -> int:  # noqa: B006
        """The kind of a group with this content.

        `sequences`: rules that are repetitions, with what cuts contents into their parts. `lists`: rules that derive any elements between
        commas, also one after the last, with the rule of the elements: parts are recognised one by one first, which is the same for contents of any
        length and quicker for long ones.
        """
        key = (bracket, content)
        kind = self.masks.get(key)
        if kind is None:
            mask = own = 0
            for i, rule in enumerate(self.contents[bracket]):
                cut, element = sequences.get(rule), lists.get(rule)
                if cut:
                    parts = all(self.derives(rule, part) for part in cut(content))
                else:
                    parts = element is not None and bool(content) and all(self.derives(element, part) for part in self._elements(content))
                if parts or self.derives(rule, content):
                    mask |= 1 << i
                    own |= self._bit["g", (bracket, rule)]
            kind = GROUP | mask << 2 | BRACKETS.index(bracket)
            self.match[kind] = own
            if len(content) <= 80:
                if len(self.masks) > MEMO:
                    self.masks.clear()
                self.masks[key] = kind
        return kind
