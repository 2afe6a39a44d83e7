"""Table-driven parsing: SLR tables from grammar texts, with conflicts kept and followed side by side."""

from __future__ import annotations

import re
from collections import defaultdict

_GRAMMAR_TOKEN = re.compile(r"'[^']+'|[A-Za-z_]+|[:;|()?*+]")
END = "$"


def read_grammar(text: str) -> list[tuple[str, tuple[str, ...]]]:
    """Plain productions of a grammar with groups, `?`, `*` and `+`. Literals lose their quotes and gain a leading blank."""
    tokens = _GRAMMAR_TOKEN.findall("\n".join(x for x in text.splitlines() if not x.startswith("#")))
    pos, out, named = 0, [], {}

    def helper(kind: str, body: str, alts: list[tuple[str, ...]]) -> str:
        """One rule for each repeated or optional part, however often it is written, so that its uses don't conflict."""
        name = f"{kind} {body}"
        if name not in named:
            named[name] = True
            out.extend((name, a) for a in alts)
        return name

    def alternatives() -> list[tuple[str, ...]]:
        nonlocal pos
        alts = [sequence()]
        while tokens[pos] == "|":
            pos += 1
            alts.append(sequence())
        return alts

    def sequence() -> tuple[str, ...]:
        nonlocal pos
        items: list[str] = []
        while tokens[pos] not in "|;)":
            t = tokens[pos]
            pos += 1
            if t == "(":
                inner = alternatives()
                pos += 1
                sym = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else helper("group", repr(inner), inner)
            else:
                sym = " " + t[1:-1] if t[0] == "'" else t
            if tokens[pos] in "?*+":
                mark = tokens[pos]
                pos += 1
                many = f"many {sym}"
                if mark in "*+":
                    helper("many", sym, [(sym,), (many, sym)])
                sym = many if mark == "+" else helper("maybe", many if mark == "*" else sym, [(), (many if mark == "*" else sym,)])
            items.append(sym)
        return tuple(items)

    while pos < len(tokens):
        name = tokens[pos]
        pos += 2
        out.extend((name, a) for a in alternatives())
        pos += 1
    return list(dict.fromkeys(out))


def build(text: str, start: str) -> tuple[list[dict], list[dict]]:
    """(actions, gotos) by state. An action is a state to shift to, one reduction (lhs, length), or a list of several of these."""
    rules = [("start'", (start,)), *read_grammar(text)]
    by_lhs = defaultdict(list)
    for i, (lhs, _) in enumerate(rules):
        by_lhs[lhs].append(i)
    nullable: set[str] = set()
    first: dict[str, set] = defaultdict(set)
    follow: dict[str, set] = defaultdict(set)
    of = lambda s: first[s] if s in by_lhs else {s}
    grown = True
    while grown:
        grown = False
        for lhs, rhs in rules:
            was = len(first[lhs]), lhs in nullable
            for s in rhs:
                first[lhs] |= of(s)
                if s not in nullable:
                    break
            else:
                nullable.add(lhs)
            grown |= was != (len(first[lhs]), lhs in nullable)
    follow["start'"].add(END)
    grown = True
    while grown:
        grown = False
        for lhs, rhs in rules:
            tail = follow[lhs]
            for s in reversed(rhs):
                if s in by_lhs:
                    n = len(follow[s])
                    follow[s] |= tail
                    grown |= n != len(follow[s])
                    tail = tail | first[s] if s in nullable else first[s]
                else:
                    tail = {s}
    closures: dict[str, frozenset] = {}

    def opened(symbol: str) -> frozenset:
        """The items that begin where `symbol` may begin."""
        if symbol not in closures:
            seen, todo = set(), [symbol]
            while todo:
                s = todo.pop()
                if s in seen or s not in by_lhs:
                    continue
                seen.add(s)
                todo += [rules[i][1][0] for i in by_lhs[s] if rules[i][1]]
            closures[symbol] = frozenset((i, 0) for s in seen for i in by_lhs[s])
        return closures[symbol]

    def closure(kernel: frozenset) -> set:
        items = set(kernel)
        for i, d in kernel:
            if d < len(rules[i][1]):
                items |= opened(rules[i][1][d])
        return items

    kernels = {frozenset({(0, 0)}): 0}
    queue, actions, gotos = [frozenset({(0, 0)})], [], []
    for kernel in queue:
        moves = defaultdict(set)
        acts: dict[str, list] = defaultdict(list)
        for i, d in closure(kernel):
            lhs, rhs = rules[i]
            if d < len(rhs):
                moves[rhs[d]].add((i, d + 1))
            else:
                for t in follow[lhs]:
                    acts[t].append((lhs, len(rhs)))
        go = {}
        for s, k in sorted(moves.items()):
            k = frozenset(k)
            if k not in kernels:
                kernels[k] = len(queue)
                queue.append(k)
            if s in by_lhs:
                go[s] = kernels[k]
            else:
                acts[s].append(kernels[k])
        actions.append({t: a[0] if len(a) == 1 else a for t, a in acts.items()})
        gotos.append(go)
    return actions, gotos


def _below(node: list, size: int, edge: tuple | None = None) -> list[list]:
    """The nodes `size` steps below `node`; with an edge (upper node, lower node), only those reached by it."""
    if edge is None:
        nodes = [node]
        for _ in range(size):
            below = {}
            for x in nodes:
                y = x[1]
                if y is not None:
                    below[id(y)] = y
                if x[2]:
                    for y in x[2]:
                        below[id(y)] = y
            nodes = list(below.values())
        return nodes
    level = {(id(node), False): node}
    for _ in range(size):
        below = {}
        for (_, used), x in level.items():
            for y in (x[1], *x[2]) if x[2] else (x[1],):
                if y is not None:
                    below[id(y), used or (x is edge[0] and y is edge[1])] = y
        level = below
    return [x for (_, used), x in level.items() if used]


def _advance(tables: tuple[list[dict], list[dict]], fresh: list[list], kind: str) -> list[list] | None:
    """The tops of all stacks after the token `kind`, or None if the whole text is read.

    The stacks form a graph: a node is [state, node below, further nodes below or None]. Stacks share what they have in common, and
    the tops at one place are told apart by their state alone, so their number is bounded by the table, whatever the text.
    """
    actions, gotos = tables
    tops = {node[0]: node for node in fresh}
    shifted: dict[int, list] = {}
    todo: list[tuple] = []
    empty = False  # whether something of no tokens was reduced, so that a top may stand on a top
    while fresh or todo:
        if fresh:
            node = fresh.pop()
            act = actions[node[0]].get(kind)
            if act is not None:
                for a in act if type(act) is list else (act,):
                    if type(a) is tuple:
                        todo.append((node, a, None))
                    elif a in shifted:
                        shifted[a][2] = [*(shifted[a][2] or ()), node]
                    else:
                        shifted[a] = [a, node, None]
            continue
        node, (lhs, size), edge = todo.pop()
        if lhs == "start'":
            return None
        if not size:
            empty = True
        if edge is None:
            while size and node[2] is None:
                node = node[1]
                size -= 1
        for base in _below(node, size, edge) if size else (node,):
            state = gotos[base[0]][lhs]
            top = tops.get(state)
            if top is None:
                tops[state] = top = [state, base, None]
                fresh.append(top)
            elif top[1] is not base and not (top[2] and any(b is base for b in top[2])):
                top[2] = [*(top[2] or ()), base]  # a new way down: what reduces across it does so again
                for x in tops.values() if empty else (top,):
                    act = actions[x[0]].get(kind)
                    todo += [(x, a, (top, base)) for a in (act if type(act) is list else (act,)) if type(a) is tuple and a[1]]
    return list(shifted.values())


def first_error(tables: tuple[list[dict], list[dict]], kinds: list[str]) -> int:
    """The place of the first token after which nothing the grammar allows begins with what was read; -1 if all is valid.

    One stack is followed as long as the tables allow one action; where they allow several, all are followed on a graph of stacks.
    The work is polynomial in the number of tokens, however ambiguous the text.
    """
    actions, gotos = tables
    tops: list[list] = [[0, None, None]]
    for n, kind in enumerate([*kinds, END]):
        if len(tops) == 1:
            node = tops[0]
            while True:
                act = actions[node[0]].get(kind)
                if type(act) is int:
                    tops = [[act, node, None]]
                    break
                if act is None:
                    return n
                if type(act) is list:
                    tops = [node]
                    break
                lhs, size = act
                if lhs == "start'":
                    return -1
                base = node
                while size and base[2] is None:
                    base = base[1]
                    size -= 1
                if size:
                    tops = [node]
                    break
                node = [gotos[base[0]][lhs], base, None]
            if type(act) is int:
                continue
        after = _advance(tables, tops, kind)
        if after is None:
            return -1
        if not after:
            return n
        tops = after
    return len(kinds)
