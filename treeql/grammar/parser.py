"""A table-driven parser that forks on ambiguity and recovers from errors.

A stack entry is (state, node, entry below). Stacks advance token by token, the one furthest behind first; stacks with the same states at the same place
are merged, the better one staying: fewer errors, then the higher dynamic precedence. Where no stack can go on, a token may be taken for granted (MISSING), the stack may be cut back to a state that can
take the token, the cut nodes forming an ERROR, or the token goes into an ERROR.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import regex

from ..tree import Node, Tree, uncollected
from .compiler import END, Language

MAX_STACKS = 8
#: A parse that lost stacks to the cap, or came to its limit of nodes, is tried again with so many times the room, for texts of up to so many bytes.
WIDER, RETRY_BYTES = 8, 1 << 20
#: (text) -> (place -> next token there or behind it as (name, start, end), or None at the end)
TokenSource = Callable[[bytes], Callable[[int], tuple[str, int, int] | None]]


@dataclass
class Token:
    name: str
    start: int
    end: int
    named: bool = False
    memo: bytes = b""


@dataclass(eq=False)
class _Stack:
    at: int
    state: int
    below: tuple | None = None  # (state before, node, below)
    score: int = 0
    errors: int = 0
    memo: bytes = b""  # the scanner's state


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without empty ones, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(r for r in ranges if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def blank_outside(source: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text with blanks for all bytes outside of the ranges, line ends kept."""
    out, at = [], 0
    blank = lambda x: bytes(10 if c == 10 else 32 for c in x)
    for a, b in merge_ranges(ranges):
        out += [blank(source[at:a]), source[a:b]]
        at = b
    return b"".join(out) + blank(source[at:])


class Parser:
    """Parses texts of one language; keeps the order in which each state's terminals are tried."""

    def __init__(self, language: Language, max_stacks: int = MAX_STACKS):
        self.language, self.max_stacks = language, max_stacks
        # what a text is read by where nothing fits; tokens that must follow another at once mean nothing there
        self._all = [t for t in self._ordered(set(language.terminals)) if not t.immediate]
        self._extras = [language.terminals[x] for x in language.extras]
        self._by_byte: dict[tuple[int, int], tuple[list, list]] = {}
        # for states with one action on a token: a shift's state, or a reduction's number as -1, -2 ..
        one = lambda a: a[1] if a[0] == "shift" else -1 - a[1]
        self._single = [{name: one(acts[0]) for name, acts in table.items() if len(acts) == 1 and acts[0][0] != "accept"} for table in language.actions]
        # of each production: left side, length, dynamic precedence, whether it is hidden, whether a part is hidden, whether a part has a name of its own or a field,
        # and whether its one part may stand for it: a hidden name that is never renamed leaves nothing else behind
        renamed = {x.name for p in language.productions for x in p.right if x.alias} | {language.start}
        self._shapes = []
        for p in language.productions:
            own = any(x.alias or x.field for x in p.right)
            self._shapes.append((p.left, len(p.right), p.dynamic, language.hidden(p.left), any(language.hidden(x.name) for x in p.right), own, language.hidden(p.left) and len(p.right) == 1 and not own and p.left not in renamed))
        self._lexed: dict[int, tuple] = {}
        self._first: dict[str, list[int]] = {}
        # of the parse at hand: where its tokens come from, if not from the grammar, whether the cap cut stacks off, and how many nodes it made
        self._next: Callable | None = None
        self._culled, self._made = False, 0

    def _ordered(self, names: set[str]) -> list:
        return sorted((self.language.terminals[n] for n in names if n in self.language.terminals), key=lambda t: (-t.level, not t.is_string, t.order))

    # tokens

    def _longest(self, terminals: list, source: bytes, at: int):
        best, end = None, at
        for t in terminals:
            m = t.regex.match(source, at) if t.regex else None
            if m and (m.end() > end or (best is not None and m.end() == end and t.level > best.level)):
                best, end = t, m.end()
        return best, end

    @staticmethod
    def _may_start(terminal, byte: int) -> bool:
        """Whether some text that begins with a byte may match; external tokens are the scanner's."""
        if terminal.regex is None:
            return False
        return regex.compile(terminal.regex.pattern).match(bytes([byte]), partial=True) is not None

    def _candidates(self, state: int, byte: int) -> tuple[list, list]:
        """A state's terminals and the extras that may start with a byte (-1: the end of the text)."""
        found = self._by_byte.get((state, byte))
        if found is None:
            wanted = self._ordered(set(self.language.actions[state]))
            may = (lambda t: self._may_start(t, byte)) if byte >= 0 else (lambda t: False)
            found = self._by_byte[state, byte] = [t for t in wanted if may(t)], [t for t in self._extras if may(t)]
        return found

    def lex(self, state: int, source: bytes, at: int, memo: bytes = b"") -> Iterator[Token]:
        """Extras in front of a state's next token, then the token itself (END at the end, an empty name if nothing fits).

        A language's scanner is asked first for the external tokens that the state can take.
        """
        if self._next is not None:
            yield from self._given(state, source, at, memo)
            return
        moved, size = False, len(source)
        externals = [n for n in self.language.externals if n in self.language.actions[state]]
        while True:
            if externals and (found := self.language.scanner.scan(source, at, externals, memo)):
                name, end, memo = found
                yield Token(name, at, end, not self.language.hidden(name), memo)
                return
            usable, extras = self._candidates(state, source[at] if at < size else -1)
            if moved:
                usable = [t for t in usable if not t.immediate]
            best, end = self._longest(usable, source, at)
            extra, extra_end = self._longest(extras, source, at) if extras else (None, at)
            if extra and (not best or extra_end > end):
                if not self.language.hidden(extra.name):
                    yield Token(extra.name, at, extra_end, True, memo)
                at, moved = extra_end, True
                continue
            if best:
                yield Token(best.name, at, end, best.named, memo)
                return
            if at >= len(source):
                yield Token(END, at, at, False, memo)
                return
            other, end = self._longest(self._all, source, at)
            if other:
                yield Token(other.name, at, end, other.named, memo)
            else:
                end = at + 1
                while end < len(source) and source[end] & 0xC0 == 0x80:
                    end += 1
                yield Token("", at, end, False, memo)
            return

    def _given(self, state: int, source: bytes, at: int, memo: bytes) -> Iterator[Token]:
        """As `lex`, with the tokens of a token source; one of a name that the grammar doesn't know is an error."""
        extras, actions = self.language.extras, self.language.actions[state]
        while True:
            found = self._next(at)
            if found is None:
                yield Token(END, len(source), len(source), False, memo)
                return
            name, start, end = found
            if start < at or end <= start or end > len(source):
                raise ValueError(f"token {name} at {start} to {end}, behind {at} of {len(source)} bytes")
            terminal = self.language.terminals.get(name)
            if terminal is None or name not in extras or name in actions:
                yield Token(name if terminal else "", start, end, bool(terminal and terminal.named), memo)
                return
            if not self.language.hidden(name):
                yield Token(name, start, end, True, memo)
            at = end

    # stacks

    def _reduce(self, stack: _Stack, number: int) -> _Stack | None:
        self._made += 1
        p = self.language.productions[number]
        taken, below, state = [], stack.below, stack.state
        need = len(p.right)
        while need:
            if below is None:
                return None
            state, node, below = below
            taken.append(node)
            need -= not node.extra
        # extras in front stay outside
        taken.reverse()
        node = self._node(p, taken, stack.at)
        to = self.language.gotos[state].get(p.left)
        if to is None:
            return None
        return _Stack(stack.at, to, (state, node, below), stack.score + p.dynamic, stack.errors, stack.memo)

    def _node(self, p, taken: list[Node], at: int) -> Node:
        """A production's node. Hidden nodes keep their parts as they are; a visible one takes what they hold, once, so that long repetitions stay linear."""
        parts, children, k = p.right, [], 0
        for n in taken:
            if not n.extra:
                part = parts[k]
                k += 1
                if part.alias or part.field:
                    n = self._copy(n, part.alias or n.type, part.alias_named if part.alias else n.named)
                    n.field = part.field or n.field
            children.append(n)
        start, end = (taken[0].start, taken[-1].end) if taken else (at, at)
        if not self.language.hidden(p.left):
            children = self.visible(children)
        return Node(p.left, True, start, end, children)

    def visible(self, nodes: list[Node]) -> list[Node]:
        """`nodes` with hidden ones replaced by what they hold; the field of a hidden node goes to those of its nodes that have none."""
        for n in nodes:
            if n.type[:1] == "_":
                break
        else:
            return nodes
        out, stack = [], list(reversed(nodes))
        fields: dict[int, str] = {}  # of nodes below hidden ones with a field
        while stack:
            n = stack.pop()
            own = fields.pop(id(n), None) if fields else None
            if n.type[:1] == "_":
                field_ = n.field or own
                if field_:
                    for c in n.children:
                        fields[id(c)] = field_
                stack += reversed(n.children)
            elif own and not n.field and not n.extra:
                n = self._copy(n, n.type, n.named)
                n.field = own
                out.append(n)
            else:
                out.append(n)
        return out

    @staticmethod
    def _copy(n: Node, kind: str, named: bool) -> Node:
        return Node(kind, named, n.start, n.end, n.children, n.field, extra=n.extra, missing=n.missing, error=n.error)

    def _actions(self, stack: _Stack, name: str) -> list[tuple]:
        return self.language.actions[stack.state].get(name, [])

    def _after_reductions(self, stack: _Stack, name: str) -> list[_Stack]:
        """Stacks that can shift or accept `name`, after all reductions that it allows."""
        out, todo, seen = [], [stack], 0
        while todo and seen < 10_000:
            s = todo.pop()
            seen += 1
            for a in self._actions(s, name):
                if a[0] == "reduce":
                    r = self._reduce(s, a[1])
                    if r is not None:
                        todo.append(r)
                elif s not in out:
                    out.append(s)
        unique = {}
        for s in out:
            unique.setdefault((s.state, id(s.below)), s)
        return list(unique.values())

    def _shift(self, s: _Stack, token: Token) -> _Stack:
        to = next(a[1] for a in self._actions(s, token.name) if a[0] == "shift")
        leaf = Node(token.name, token.named, token.start, token.end)
        return _Stack(token.end, to, (s.state, leaf, s.below), s.score, s.errors, token.memo)

    @staticmethod
    def _push_extra(s: _Stack, node: Node) -> _Stack:
        node.extra = True
        return _Stack(max(s.at, node.end), s.state, (s.state, node, s.below), s.score, s.errors + node.error, s.memo)

    def _step(self, s: _Stack, source: bytes) -> tuple[list[_Stack], Node | None, Token, _Stack]:
        """Advance by one token: (stacks, root if accepted, token, the stack with the extras before it, or the one accepted)."""
        token = None
        for token in self.lex(s.state, source, s.at, s.memo):
            if token.name in self.language.extras and token.name not in self.language.actions[s.state]:
                s = self._push_extra(s, Node(token.name, True, token.start, token.end))
        # most states have one action for a token: follow these without forking
        now, table = s, self.language.actions
        for _ in range(10_000):
            acts = table[now.state].get(token.name)
            if not acts or len(acts) > 1:
                break
            if acts[0][0] == "reduce":
                reduced = self._reduce(now, acts[0][1])
                if reduced is None:
                    break
                now = reduced
            elif acts[0][0] == "shift":
                leaf = Node(token.name, token.named, token.start, token.end)
                return [_Stack(token.end, acts[0][1], (now.state, leaf, now.below), now.score, now.errors, token.memo)], None, token, s
            else:
                return [], self._root(now, len(source)), token, now
        ready = self._after_reductions(s, token.name)
        whole = [r for r in ready if ("accept",) in self._actions(r, token.name)]
        if whole:
            best = min(whole, key=lambda r: (r.errors, -r.score))
            return [], self._root(best, len(source)), token, best
        return [self._shift(r, token) for r in ready if any(a[0] == "shift" for a in self._actions(r, token.name))], None, token, s

    def _straight(self, s: _Stack, source: bytes, limit: int) -> _Stack:
        """Follow a lone stack as far as every token has one action: the greater part of most texts. Extras that make nodes, external tokens, conflicts, errors and
        the end of the text are left to `_step`."""
        if self.language.externals or self._next is not None:
            return s
        budget = limit - self._made
        single, shapes, gotos, productions, lexed = self._single, self._shapes, self.language.gotos, self.language.productions, self._lexed
        state, below, score, size = s.state, s.below, s.score, len(source)
        at = place = s.at  # `at`: where the last token ended, `place`: behind blanks
        while place < size and budget > 0:
            key = state << 8 | source[place]
            usable, extras, blank, sole, skip = lexed.get(key) or self._lex_entry(key)
            if skip is not None and (m := skip(source, place)) and m.end() > place:
                place = m.end()
                continue
            if sole is not None:
                best, end = sole, place + 1
            else:
                best, end = None, place
                for t in usable:
                    if t[4] and place != at:
                        continue
                    m = t[0](source, place)
                    if m:
                        to = m.end()
                        if to > end or (best is not None and to == end and t[3] > best[3]):
                            best, end = t, to
            if extras:
                extra, extra_end = self._longest(extras, source, place)
                if extra and (not best or extra_end > end):
                    if not blank:
                        break
                    place = extra_end
                    continue
            if best is None:
                break
            name, now, under, sum_ = best[1], state, below, score
            to = single[now].get(name)
            budget -= 1
            while to is not None and to < 0:
                budget -= 1
                number = -1 - to
                left, need, dynamic, is_hidden, takes_hidden, named_parts, through = shapes[number]
                if through and under is not None and not under[1].extra and under[1].field is None:
                    before, node, popped = under
                    goto = gotos[before].get(left)
                    if goto is None:
                        to = None
                        break
                    now, sum_, under = goto, sum_ + dynamic, (before, node, popped)
                    to = single[now].get(name)
                    continue
                taken, popped = [], under
                while need and popped is not None:
                    now, node, popped = popped
                    taken.append(node)
                    if not node.extra:
                        need -= 1
                goto = gotos[now].get(left) if not need else None
                if goto is None:
                    to = None
                    break
                taken.reverse()
                if named_parts:
                    node = self._node(productions[number], taken, at)
                else:
                    first, last = (taken[0].start, taken[-1].end) if taken else (at, at)
                    node = Node(left, True, first, last, self.visible(taken) if takes_hidden and not is_hidden else taken)
                under, now, sum_ = (now, node, popped), goto, sum_ + dynamic
                to = single[now].get(name)
            if to is None:
                break
            below, state, score, at = (now, Node(name, best[2], place, end), under), to, sum_, end
            place = end
        self._made = limit - budget
        return _Stack(at, state, below, score, s.errors, s.memo)

    def _lex_entry(self, key: int) -> tuple:
        usable, extras = self._candidates(key >> 8, key & 255)
        found = [(t.regex.match, t.name, t.named, t.level, t.immediate) for t in usable]
        # a byte that is a token of its own, with no other way to read it
        sole = found[0] if len(usable) == 1 and not extras and not usable[0].immediate and usable[0].regex.pattern in (re.escape(bytes([key & 255])), bytes([key & 255])) else None
        # a run of blanks in one step, where nothing else may start with any of them
        skip, blank = None, all(self.language.hidden(t.name) for t in extras)
        if len(extras) == 1 and not usable and blank and not any(self._candidates(key >> 8, b)[0] for b in self._starts(extras[0])):
            skip = re.compile(b"(?:" + extras[0].regex.pattern + b")+").match
        entry = self._lexed[key] = found, extras, blank, sole, skip
        return entry

    def _starts(self, terminal) -> list[int]:
        """The bytes that a terminal may start with."""
        found = self._first.get(terminal.name)
        if found is None:
            found = self._first[terminal.name] = [b for b in range(256) if self._may_start(terminal, b)]
        return found

    def _root(self, s: _Stack, size: int) -> Node:
        parts, below = [], s.below
        while below is not None:
            parts.append(below[1])
            below = below[2]
        parts.reverse()
        root = next(n for n in parts if not n.extra)
        children = []
        for n in parts:
            children.extend(n.children if n is root else [n])
        return Node(root.type, True, parts[0].start if parts else 0, size, children)

    def _recover(self, s: _Stack, token: Token) -> _Stack:
        if token.name:
            for t in self._ordered(set(self.language.actions[s.state])):
                for r in self._after_reductions(s, t.name):
                    if not any(a[0] == "shift" for a in self._actions(r, t.name)):
                        continue
                    to = next(a[1] for a in self._actions(r, t.name) if a[0] == "shift")
                    leaf = Node(t.name, t.named, s.at, s.at, missing=True)
                    tried = _Stack(s.at, to, (r.state, leaf, r.below), r.score, s.errors + 1, s.memo)
                    if self._after_reductions(tried, token.name):
                        return tried
            cut, state, below = [], s.state, s.below
            while below is not None and len(cut) < 200:
                state, node, below = below
                cut.append(node)
                back = _Stack(s.at, state, below, s.score, s.errors, s.memo)
                if self._after_reductions(back, token.name):
                    inside = self.visible(cut[::-1])
                    return self._push_extra(back, Node("ERROR", True, cut[-1].start, cut[0].end, inside, error=True))
        leaf = [Node(token.name, token.named, token.start, token.end)] if token.name and not self.language.hidden(token.name) else []
        if s.below is not None and s.below[1].error and s.below[1].extra and s.below[1].end <= token.start:
            old = s.below[1]
            grown = Node("ERROR", True, old.start, token.end, [*old.children, *leaf], error=True)
            return self._push_extra(_Stack(s.at, s.below[0], s.below[2], s.score, s.errors - 1, s.memo), grown)
        return self._push_extra(s, Node("ERROR", True, token.start, token.end, leaf, error=True))

    def parse(
        self, source: bytes, max_steps: int | None = None, ranges: list[tuple[int, int]] | None = None, seconds: float | None = None, *,
        tokens: TokenSource | None = None, cancelled: Callable[[], bool] | None = None, max_nodes: int | None = None, max_depth: int | None = None, log: Callable[[str, str], None] | None = None,
    ) -> Tree:
        """The tree of a text; one without any tree has an ERROR over all of it.

        `ranges`: only these stretches of bytes are read, the rest counts as blank. `tokens`: where tokens come from instead of the grammar. `max_nodes`: nodes that may be made,
        by default 300,000 or 52 for each byte; `max_depth`: entries that a stack may have. `cancelled` is asked now and then, `log` is told (kind, message) of each token, recovery and
        second parse. `stop_reason` of the tree says how the parse ended: accepted, no_stacks_alive, iteration_limit, node_limit, stack_depth_limit, timeout or cancelled.

        A parse that ends without a tree or with errors after stacks had to be given up, or that comes to the default limit of nodes, is made again with more room; the better of the
        two trees stays (`preferred`).
        """
        text = blank_outside(source, ranges) if ranges is not None else source
        nodes = max_nodes or max(300_000, 52 * len(source))
        self._next = tokens(text) if tokens else None
        try:
            with uncollected():
                tree = self._parse(text, max_steps, seconds, nodes, max_depth, cancelled, log)
                short = tree.stop_reason == "node_limit" and max_nodes is None
                lost = self._culled and (tree.stop_reason == "no_stacks_alive" or (tree.stop_reason == "accepted" and tree.has_error))
                if (short or lost) and len(source) <= RETRY_BYTES:
                    if log:
                        log("parse", f"again after {tree.stop_reason}")
                    narrow, self.max_stacks = self.max_stacks, self.max_stacks * WIDER
                    try:
                        again = self._parse(text, max_steps, seconds, nodes * WIDER, max_depth, cancelled, log)
                    finally:
                        self.max_stacks = narrow
                    tree = again if preferred(again, tree) else tree
        finally:
            self._next = None
        tree.source = source
        return tree

    def _parse(self, source: bytes, max_steps: int | None, seconds: float | None, max_nodes: int, max_depth: int | None, cancelled, log) -> Tree:
        stacks = [_Stack(0, 0)]
        steps, limit = 0, max_steps or max(10_000, 30 * len(source))
        until, reason = time.monotonic() + seconds if seconds is not None else None, ""
        self._culled, self._made, whole = False, 0, None
        stepwise = until is not None or cancelled is not None or max_depth is not None or log is not None
        while stacks:
            if steps >= limit:
                reason = "iteration_limit"
            elif self._made >= max_nodes:
                reason = "node_limit"
            elif until is not None and steps % 64 == 0 and time.monotonic() > until:
                reason = "timeout"
            elif cancelled is not None and steps % 64 == 0 and cancelled():
                reason = "cancelled"
            elif max_depth is not None and all(self._deeper(s, max_depth) for s in stacks):
                reason = "stack_depth_limit"
            if reason:
                s = stacks[0]
                break
            steps += 1
            k = min(range(len(stacks)), key=lambda i: stacks[i].at)
            s = stacks.pop(k)
            if not stacks and not stepwise:
                s = self._straight(s, source, max_nodes)
            onward, root, token, s = self._step(s, source)
            self._made += len(onward)
            if log:
                log("lex", f"{token.name or 'unknown'} {token.start} {token.end}")
            if root is not None:
                if whole is None or (s.errors, -s.score) < whole[:2]:
                    whole = s.errors, -s.score, root
                if not stacks:
                    break
                continue
            if len(onward) == 1 and not stacks:
                stacks = onward
            elif onward:
                stacks = self._merged(stacks + onward)
            elif not stacks and whole is not None:
                break
            elif not stacks:
                if log:
                    log("parse", f"recover at {token.start}")
                if token.name == END:
                    found = self._missing_end(s)
                    if found is None:
                        break
                    stacks = [found]
                else:
                    stacks = [self._recover(s, token)]
        if whole is not None:
            return Tree(whole[2], source)
        last = s if steps else None
        parts = []
        below = last.below if last else None
        while below is not None:
            parts.append(below[1])
            below = below[2]
        inside = self.visible(parts[::-1])
        tree = Tree(Node("ERROR", True, 0, len(source), inside, error=True), source)
        tree.stop_reason = reason or "no_stacks_alive"
        return tree

    @staticmethod
    def _deeper(s: _Stack, n: int) -> bool:
        below = s.below
        while below is not None and n > 0:
            below, n = below[2], n - 1
        return below is not None

    def _missing_end(self, s: _Stack) -> _Stack | None:
        """At the end of a text: a stack with one more token taken for granted, if that leads on."""
        if s.errors > 50:
            return None
        for t in self._ordered(set(self.language.actions[s.state])):
            for r in self._after_reductions(s, t.name):
                if any(a[0] == "shift" for a in self._actions(r, t.name)):
                    to = next(a[1] for a in self._actions(r, t.name) if a[0] == "shift")
                    tried = _Stack(s.at, to, (r.state, Node(t.name, t.named, s.at, s.at, missing=True), r.below), r.score, s.errors + 1, s.memo)
                    if self._after_reductions(tried, END):
                        return tried
        cut, below = [], s.below
        while below is not None:
            state, node, below = below
            cut.append(node)
            back = _Stack(s.at, state, below, s.score, s.errors + 1, s.memo)
            if self._after_reductions(back, END):
                inside = self.visible(cut[::-1])
                return self._push_extra(back, Node("ERROR", True, cut[-1].start, cut[0].end, inside, error=True))
        return None

    def _merged(self, stacks: list[_Stack]) -> list[_Stack]:
        best: dict[tuple[int, int, bytes], list[_Stack]] = {}
        for s in stacks:
            alike = best.setdefault((s.state, s.at, s.memo), [])
            for k, old in enumerate(alike):
                if self._same_states(s.below, old.below):
                    if (s.errors, -s.score) < (old.errors, -old.score):
                        alike[k] = s
                    break
            else:
                alike.append(s)
        found = sorted((s for alike in best.values() for s in alike), key=lambda s: (s.errors, -s.score))
        self._culled |= len(found) > self.max_stacks
        return found[: self.max_stacks]

    @staticmethod
    def _same_states(a: tuple | None, b: tuple | None) -> bool:
        """Whether two stacks stand on the same states all the way down, so that whatever follows can do the same with either."""
        while a is not b:
            if a is None or b is None or a[0] != b[0]:
                return False
            a, b = a[2], b[2]
        return True


def preferred(new: Tree, old: Tree) -> bool:
    """Whether a second tree is better: whole and without errors, else further to the end, not stopped by a limit, without errors, then of fewer nodes below the root, then of fewer nodes."""

    def rank(t: Tree) -> tuple:
        bad, root = t.has_error, t.root
        whole = t.stop_reason == "accepted"
        end = max((n.end for n in root.children), default=0) if root.error else root.end
        return whole and not bad, end, whole, not bad, t.stop_reason == "no_stacks_alive", -len(root.children), -len(t.nodes)

    clean = rank(old)[0]
    return not clean and rank(new) > rank(old)
