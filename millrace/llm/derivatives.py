"""Memoised parsing with derivatives over token kinds.

A language is a node: a token, a sequence, a choice, a repetition or a named rule. Reading a token replaces the language
by its derivative, the language of what may follow. Nodes are built once each (hash consing) and remember their
derivatives, so parsing settles into walking a lazily built automaton; whole stretches of tokens are remembered as well.
The empty language marks the first token no text of the language continues with; if the text ends while the language
does not hold the empty string, the text is cut short. Rules may be ambiguous but not left-recursive.
"""

from __future__ import annotations

import re
import sys

#: Nodes and remembered stretches before the engine starts anew, and the longest stretch worth remembering; only memory
#: and time depend on them.
MOST_NODES, MOST_JUMPS, LONGEST = 200_000, 400_000, 256


class Node:
    __slots__ = ("kind", "a", "b", "nullable", "derived", "jumps", "number")

    def __init__(self, kind: str, a, b, number: int):
        self.kind, self.a, self.b, self.number = kind, a, b, number
        self.nullable: bool | None = None
        self.derived: dict[int, Node] = {}
        self.jumps: dict[bytes, Node] = {}


class Language:
    """The rules of an EBNF text over single-byte token kinds, and the state after any read token."""

    def __init__(self, rules: str, start: str, kinds: dict[str, int]):
        self.text, self.kinds, self.start_rule = rules, kinds, start
        self.reset()

    def reset(self) -> None:
        self.nodes: dict[tuple, Node] = {}
        self.remembered = 0
        self.empty = self._node("empty", None, None)
        self.null = self._node("null", None, None)
        self.rules: dict[str, Node] = {}
        for rule in re.split(r";\s*\n", self.text):
            if rule.strip():
                name, _, body = rule.partition("=")
                self.rules[name.strip()] = self._read(body)
        self.start = self.ref(self.start_rule)

    # ---- building

    def _node(self, kind: str, a, b) -> Node:
        key = (kind, a.number if isinstance(a, Node) else a, b.number if isinstance(b, Node) else b)
        found = self.nodes.get(key)
        if found is None:
            found = self.nodes[key] = Node(kind, a, b, len(self.nodes))
        return found

    def token(self, kind: int) -> Node:
        return self._node("token", kind, None)

    def ref(self, name: str) -> Node:
        return self._node("ref", name, None)

    def seq(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.null:
            return b
        if b is self.null:
            return a
        if a.kind == "seq":
            return self.seq(a.a, self.seq(a.b, b))
        return self._node("seq", a, b)

    def star(self, a: Node) -> Node:
        return self.null if a in (self.empty, self.null) else a if a.kind == "star" else self._node("star", a, None)

    def choice(self, options: list[Node]) -> Node:
        flat: dict[int, Node] = {}
        stack = list(options)
        while stack:
            o = stack.pop()
            if o.kind == "choice":
                stack.extend(o.a)
            elif o is not self.empty:
                flat[o.number] = o
        tails: dict[int, list[Node]] = {}
        for o in flat.values():
            if o.kind == "seq":
                tails.setdefault(o.b.number, []).append(o)
        for number, group in tails.items():
            bare = flat.get(number)
            if len(group) > 1 or bare is not None:
                for o in group:
                    del flat[o.number]
                heads = [o.a for o in group]
                if bare is not None:
                    del flat[number]
                    heads.append(self.null)
                joined = self.seq(self.choice(heads), group[0].b)
                return self.choice([joined, *flat.values()])
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        members = tuple(flat[n] for n in sorted(flat))
        key = ("choice", tuple(m.number for m in members), None)
        found = self.nodes.get(key)
        if found is None:
            found = self.nodes[key] = Node("choice", members, None, len(self.nodes))
        return found

    def _read(self, body: str) -> Node:
        words = re.findall(r"'[^']+'|[A-Za-z_]\w*|[()|?*+]", body)
        at = 0

        def alternatives() -> Node:
            nonlocal at
            options = [sequence()]
            while at < len(words) and words[at] == "|":
                at += 1
                options.append(sequence())
            return self.choice(options)

        def sequence() -> Node:
            nonlocal at
            parts = []
            while at < len(words) and words[at] not in ("|", ")"):
                word = words[at]
                at += 1
                if word == "(":
                    item = alternatives()
                    at += 1
                elif word[0] == "'":
                    item = self.token(self.kinds[word[1:-1]])
                elif word.isupper():
                    item = self.token(self.kinds[word])
                else:
                    item = self.ref(word)
                if at < len(words) and words[at] in "?*+":
                    item = {"?": lambda i: self.choice([i, self.null]), "*": self.star, "+": lambda i: self.seq(i, self.star(i))}[words[at]](item)
                    at += 1
                parts.append(item)
            result = self.null
            for part in reversed(parts):
                result = self.seq(part, result)
            return result

        return alternatives()

    # ---- reading

    def nullable(self, n: Node) -> bool:
        if n.nullable is None:
            if n.kind in ("empty", "token"):
                n.nullable = False
            elif n.kind in ("null", "star"):
                n.nullable = True
            elif n.kind == "seq":
                n.nullable = self.nullable(n.a) and self.nullable(n.b)
            elif n.kind == "choice":
                n.nullable = any(self.nullable(m) for m in n.a)
            else:
                n.nullable = self.nullable(self.rules[n.a])
        return n.nullable

    def derive(self, n: Node, kind: int) -> Node:
        found = n.derived.get(kind)
        if found is not None:
            return found
        if n.kind == "token":
            result = self.null if n.a == kind else self.empty
        elif n.kind == "seq":
            result = self.seq(self.derive(n.a, kind), n.b)
            if self.nullable(n.a):
                result = self.choice([result, self.derive(n.b, kind)])
        elif n.kind == "choice":
            result = self.choice([self.derive(m, kind) for m in n.a])
        elif n.kind == "star":
            result = self.seq(self.derive(n.a, kind), n)
        elif n.kind == "ref":
            result = self.derive(self.rules[n.a], kind)
        else:
            result = self.empty
        n.derived[kind] = result
        return result

    def jump(self, n: Node, kinds: bytes) -> Node:
        """The derivative by a stretch of tokens."""
        found = n.jumps.get(kinds)
        if found is None:
            found = n
            for kind in kinds:
                found = found.derived.get(kind) or self.derive(found, kind)
                if found is self.empty:
                    break
            if len(kinds) <= LONGEST:
                n.jumps[kinds] = found
                self.remembered += 1
        return found

    def read(self, stretches: list[bytes]) -> tuple[int, bool]:
        """(number of tokens read before the language became empty, or -1; whether the end is accepted)."""
        if len(self.nodes) > MOST_NODES or self.remembered > MOST_JUMPS:
            self.reset()
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 20_000))
        try:
            state, done = self.start, 0
            for stretch in stretches:
                after = state.jumps.get(stretch) or self.jump(state, stretch)
                if after is self.empty:
                    for kind in stretch:
                        state = self.derive(state, kind)
                        if state is self.empty:
                            return done, False
                        done += 1
                state, done = after, done + len(stretch)
            return -1, self.nullable(state)
        finally:
            sys.setrecursionlimit(limit)
