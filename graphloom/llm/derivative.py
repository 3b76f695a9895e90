"""Memoised parsing with derivatives over token kinds.

A grammar's language after some tokens is itself an expression: the derivative of the grammar
by those tokens. Expressions are hash-consed, so equal languages are one object, and every
object remembers its derivative by each token kind it has met. Files of a language share these
objects; parsing a token is then one dictionary lookup. The empty expression marks the token
that cannot be; an expression that is not nullable at the end marks truncation.

Grammars are written without left recursion, as rules `name = body ;` with '|', '*', '+', '?',
parentheses, quoted terminals, UPPER names for token kinds and lower names for rules.
"""

from __future__ import annotations

import itertools
import re
import sys

EMPTY_TAG, EPS_TAG, TOKEN_TAG, CAT_TAG, ALT_TAG, STAR_TAG, REF_TAG = range(7)


class Node:
    __slots__ = ("tag", "a", "b", "memo", "nullable", "n")

    def __init__(self, tag: int, a, b, n: int):
        self.tag, self.a, self.b, self.n = tag, a, b, n
        self.memo: dict[str, Node] = {}
        self.nullable: bool | None = None


class Grammar:
    """Rules compiled to expressions; parse() runs token kinds through their derivatives."""

    #: Expressions kept before the memo starts over.
    MOST = 400_000
    #: Frames of these functions live on the heap; only ambiguous ends (an `else` to any of many open `if`s) nest them.
    DEPTH = 1_000_000

    def __init__(self, text: str, start: str):
        self._text, self._start = text, start
        self._build()

    def _build(self) -> None:
        self._made: dict[tuple, Node] = {}
        self._count = itertools.count()
        self.empty = self._node(EMPTY_TAG, None, None)
        self.eps = self._node(EPS_TAG, None, None)
        self.empty.nullable, self.eps.nullable = False, True
        self.rules: dict[str, Node] = {}
        tokens = re.findall(r"'[^']*'|[A-Za-z_0-9]+|[=|*+?();]", re.sub(r"(?m)^\s*//.*$", "", self._text))
        at = 0
        while at < len(tokens):
            name = tokens[at]
            body, at = self._alternatives(tokens, at + 2)
            at += 1
            self.rules[name] = body
        self._fix_nullable()
        self.start = self.rules[self._start]
        self._own = dict(self._made)

    def _alternatives(self, t: list[str], at: int) -> tuple[Node, int]:
        out = []
        while True:
            seq, at = self._sequence(t, at)
            out.append(seq)
            if at < len(t) and t[at] == "|":
                at += 1
                continue
            return self.alt(out), at

    def _sequence(self, t: list[str], at: int) -> tuple[Node, int]:
        parts = []
        while at < len(t) and t[at] not in ("|", ")", ";"):
            x = t[at]
            if x == "(":
                node, at = self._alternatives(t, at + 1)
                at += 1
            else:
                node = self._node(TOKEN_TAG, sys.intern(x[1:-1] if x[0] == "'" else x), None) if x[0] == "'" or x.isupper() else self._node(REF_TAG, x, None)
                at += 1
            while at < len(t) and t[at] in "*+?":
                if t[at] == "?":
                    node = self.alt([node, self.eps])
                else:
                    star = self._node(STAR_TAG, node, None)
                    node = star if t[at] == "*" else self.cat(node, star)
                at += 1
            parts.append(node)
        out = self.eps
        for p in reversed(parts):
            out = self.cat(p, out)
        return out, at

    def _node(self, tag: int, a, b) -> Node:
        key = (tag, a if isinstance(a, (str, frozenset)) or a is None else a.n, None if b is None else b.n)
        node = self._made.get(key)
        if node is None:
            node = self._made[key] = Node(tag, a, b, next(self._count))
        return node

    def cat(self, a: Node, b: Node) -> Node:
        if a.tag == EMPTY_TAG or b.tag == EMPTY_TAG:
            return self.empty
        if a.tag == EPS_TAG:
            return b
        if b.tag == EPS_TAG:
            return a
        if a.tag == CAT_TAG:
            return self.cat(a.a, self.cat(a.b, b))
        return self._node(CAT_TAG, a, b)

    def alt(self, parts: list[Node]) -> Node:
        flat: dict[int, Node] = {}
        todo = list(parts)
        while todo:
            p = todo.pop()
            if p.tag == ALT_TAG:
                todo.extend(p.b)
            elif p.tag != EMPTY_TAG:
                flat[p.n] = p
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        # Alternatives with one head share it. So what is open stays a plain sequence, however deep brackets nest.
        heads: dict[int, list[Node]] = {}
        for p in flat.values():
            heads.setdefault(p.a.n if p.tag == CAT_TAG else p.n, []).append(p)
        if len(heads) < len(flat):
            merged = []
            for g in heads.values():
                head = g[0].a if g[0].tag == CAT_TAG else g[0]
                merged.append(g[0] if len(g) == 1 else self.cat(head, self.alt([p.b if p.tag == CAT_TAG else self.eps for p in g])))
            return self.alt(merged)
        key = (ALT_TAG, frozenset(flat), None)
        node = self._made.get(key)
        if node is None:
            node = self._made[key] = Node(ALT_TAG, None, tuple(flat[k] for k in sorted(flat)), next(self._count))
        return node

    def _fix_nullable(self) -> None:
        """Least fixed point over the rules; other expressions are settled from it on demand."""
        known = dict.fromkeys(self.rules, False)

        def look(x: Node) -> bool:
            if x.tag == REF_TAG:
                return known[x.a]
            if x.tag == CAT_TAG:
                return look(x.a) and look(x.b)
            if x.tag == ALT_TAG:
                return any(map(look, x.b))
            return x.tag in (EPS_TAG, STAR_TAG)

        changed = True
        while changed:
            changed = False
            for name, body in self.rules.items():
                if not known[name] and look(body):
                    known[name] = changed = True
        self._known = known

    def is_nullable(self, x: Node) -> bool:
        if x.nullable is None:
            if x.tag == CAT_TAG:
                chain, y = [], x
                while y.tag == CAT_TAG and y.nullable is None and self.is_nullable(y.a):
                    chain.append(y)
                    y = y.b
                known = y.nullable if y.nullable is not None else False if y.tag == CAT_TAG else self.is_nullable(y)
                x.nullable = known
                for c in chain:
                    c.nullable = known
            elif x.tag == ALT_TAG:
                x.nullable = False
                for p in x.b:
                    if self.is_nullable(p):
                        x.nullable = True
                        break
            elif x.tag == REF_TAG:
                x.nullable = self._known[x.a]
            else:
                x.nullable = x.tag == STAR_TAG
        return x.nullable

    def derive(self, x: Node, token: str) -> Node:
        out = x.memo.get(token)
        if out is not None:
            return out
        tag = x.tag
        if tag == TOKEN_TAG:
            out = self.eps if x.a == token else self.empty
        elif tag == CAT_TAG:
            out = self.cat(self.derive(x.a, token), x.b)
            if self.is_nullable(x.a):
                parts, y = [out], x.b
                while y.tag == CAT_TAG and token not in y.memo:
                    parts.append(self.cat(self.derive(y.a, token), y.b))
                    if not self.is_nullable(y.a):
                        break
                    y = y.b
                else:
                    parts.append(self.derive(y, token))
                out = self.alt(parts)
        elif tag == ALT_TAG:
            out = self.alt([self.derive(p, token) for p in x.b])
        elif tag == STAR_TAG:
            out = self.cat(self.derive(x.a, token), x)
        elif tag == REF_TAG:
            out = self.derive(self.rules[x.a], token)
        else:
            out = self.empty
        x.memo[token] = out
        return out

    def _forget(self) -> None:
        """Drop every expression but the grammar's own; one still in use lives on, without what it remembered."""
        for node in self._made.values():
            node.memo = {}
        self._made = dict(self._own)

    def parse(self, kinds: list[str], soft: list[bool] | None = None) -> int | None:
        """None if the kinds are in the language, else the number of the failing token; their count means truncation.

        soft tells before which tokens (and the end) the token AUTO may be put in where the token itself cannot be.
        """
        if sys.getrecursionlimit() < self.DEPTH:
            sys.setrecursionlimit(self.DEPTH)
        state, empty, derive = self.start, self.empty, self.derive
        for i, k in enumerate(kinds):
            next_ = state.memo.get(k) or derive(state, k)
            if next_ is empty and soft is not None and (soft[i] or k == "}"):
                next_ = derive(derive(state, "AUTO"), k)
            if next_ is empty:
                return i
            state = next_
            if len(self._made) > self.MOST:
                self._forget()
        if self.is_nullable(state) or (soft is not None and self.is_nullable(derive(state, "AUTO"))):
            return None
        return len(kinds)
