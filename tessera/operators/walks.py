"""Closures of graphs whose rows are too many to keep: each worker holds the edges as arrays and sends on what it reaches.

The edges lie once in the shared folder, as lists by their source. A task takes a share of the starts, walks from them in memory and
gives its rows straight to what follows, so nothing but the edges and the starts is shuffled or kept. Strings and integers serve as ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch

#: Edges that a worker holds at most, 4 bytes each; beyond them callers go on with tables (`graph.reach`).
LIMIT = 60_000_000
#: Places of words that a worker holds at most in `best_linked`, 12 bytes each.
SHARE, PARTS = 20_000_000, 4096
ROWS, WIDTH = 1 << 16, 64
_HELD: dict[tuple, object] = {}


def kept(df: DataFrame) -> str:
    """`df` as Parquet in the shared folder, to be read by workers; its path."""
    path = scratch(df.sparkSession, "arrays")
    df.write.parquet(path)
    return path


def stored(edges: DataFrame, most: int | None = None) -> tuple[str, int]:
    """The path of the edges (a, b) as lists of ascending b by a, of the `most` least b each, and how many edges these are."""
    bs = F.array_sort(F.collect_set("b"))
    lists = edges.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a").agg((bs if most is None else F.slice(bs, 1, most)).alias("bs"))
    path = kept(lists)
    return path, edges.sparkSession.read.parquet(path).agg(F.coalesce(F.sum(F.size("bs")), F.lit(0))).first()[0]


def opened(path: str) -> ds.Dataset:
    """The Parquet table in a folder, named as Hadoop does."""
    path = re.sub("^file:/+", "/", path)
    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
        return ds.dataset(path, filesystem=system, format="parquet")
    return ds.dataset(path, format="parquet")


def held(make: Callable, *args) -> object:
    """What `make` gives for these arguments, the last of each kind kept by the worker for its next task."""
    if (make, args) not in _HELD:
        for k in [k for k in _HELD if k[0] is make]:
            del _HELD[k]
        _HELD[make, args] = make(*args)
    return _HELD[make, args]


class Net:
    """nodes: ids in order; the nodes that n leads to are to[first[n]:last[n]], in order. `more` are paths of tables (id) of further nodes."""

    def __init__(self, path: str, more: tuple[str, ...] = ()) -> None:
        files = list(opened(path).get_fragments())
        parts = [x for f in files for t in [f.to_table(columns=["a", "bs"])] for x in (pc.unique(t["a"]), pc.unique(_flat(t["bs"])))]
        parts += [pc.unique(opened(p).to_table(columns=["id"])["id"]) for p in more]
        nodes = pc.unique(pa.chunked_array([p for p in parts if len(p)])).drop_null() if any(map(len, parts)) else pa.array([], pa.string())
        self.nodes = nodes.take(pc.array_sort_indices(nodes))
        n, at = len(nodes), 0
        self.first, self.last, to = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for f in files:
            t = f.to_table(columns=["a", "bs"])
            size = pc.list_value_length(t["bs"]).to_numpy().astype(np.int64)
            a = self.index(t["a"])
            self.last[a] = at + np.cumsum(size)
            self.first[a] = self.last[a] - size
            to.append(self.index(_flat(t["bs"])))
            at += len(to[-1])
        self.to = np.concatenate(to) if to else np.zeros(0, np.int32)

    def index(self, ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """The places of ids among the nodes; -1 if not there."""
        if not len(self.nodes) or not len(ids):
            return np.full(len(ids), -1, np.int32)
        x = pc.fill_null(pc.index_in(ids.cast(self.nodes.type), value_set=self.nodes, skip_nulls=True), -1)
        return x.to_numpy() if isinstance(x, pa.ChunkedArray) else x.to_numpy(zero_copy_only=False)

    def edges_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all edges that leave `nodes`, the place in `nodes` and the target."""
        size = self.last[nodes] - self.first[nodes]
        return np.repeat(np.arange(len(nodes)), size), self.to[ranges(self.first[nodes], size)]

    def levels(self, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, places in `starts`, nodes) by breadth for up to 64 starts at once, a bit of a word each, from depth 1 on."""
        seen = np.zeros(len(self.nodes), np.uint64)
        np.bitwise_or.at(seen, starts, np.uint64(1) << np.arange(len(starts), dtype=np.uint64))
        active, depth = np.unique(starts), 0
        bits = seen[active]
        while len(active):
            depth += 1
            at, to = self.edges_of(active)
            new = np.zeros(len(self.nodes), np.uint64)
            np.bitwise_or.at(new, to, bits[at])
            new &= ~seen
            active = np.flatnonzero(new)
            bits = new[active]
            seen[active] |= bits
            if len(active):
                node, start = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield depth, start, active[node]

    def depths(self, starts: np.ndarray) -> np.ndarray:
        """The depth of each node below each of up to 64 starts: 0 for itself, -1 if it isn't reached."""
        out = np.full((len(starts), len(self.nodes)), -1, np.int32)
        out[np.arange(len(starts)), starts] = 0
        for depth, start, node in self.levels(starts):
            out[start, node] = depth
        return out

    def after(self, node: int, most: int) -> np.ndarray:
        """The `most` least nodes that a node leads to."""
        return self.to[self.first[node] : min(self.last[node], self.first[node] + most)]

    def budgeted(self, start: int, depth: int, frontier: int, budget: int, seen: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """As `levels` for one start, going on from the `frontier` least nodes of a level over the `budget` least edges. `seen` has -1s,
        or starts walked before."""
        level, seen[start] = np.array([start]), start
        for k in range(1, depth + 1):
            left, parts = budget, []
            for node in level[:frontier].tolist():
                parts.append(self.after(node, left))
                left -= len(parts[-1])
                if not left:
                    break
            level = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            level = level[seen[level] != start]
            if not len(level):
                return
            seen[level] = start
            yield k, level


class Named(Net):
    """Nodes that declare names and nodes that use them: one leads to all others that use a name it declares. The edges are never made,
    as their number grows with the square of a name's places."""

    def __init__(self, declared: str, used: str) -> None:
        d, u = opened(declared).to_table(columns=["a", "name"]), opened(used).to_table(columns=["a", "bs"])
        nodes = pc.unique(pa.chunked_array([*d["a"].chunks, *_flat(u["bs"]).chunks], d["a"].type))
        self.nodes = nodes.take(pc.array_sort_indices(nodes))
        size = pc.list_value_length(u["bs"]).to_numpy().astype(np.int64)
        self.last = np.cumsum(size)
        self.first = self.last - size
        self.to = self.index(_flat(u["bs"]))
        name, a = _place(d["name"], u["a"].combine_chunks()), self.index(d["a"])
        a, name = a[name >= 0], name[name >= 0]
        order, self.begin, self.count = _groups(a, len(self.nodes))
        self.names = name[order]

    def after(self, node: int, most: int) -> np.ndarray:
        names = self.names[self.begin[node] : self.begin[node] + self.count[node]].tolist()
        # One more of each than asked for, as the node may be among them.
        parts = [self.to[self.first[x] : min(self.last[x], self.first[x] + most + 1)] for x in names]
        to = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else self.to[:0]
        return to[to != node][:most]

    def users_in(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`first`, `last` and `to` with only those users of a name that are `good`."""
        kept = good[self.to]
        before = np.concatenate([[0], np.cumsum(kept)])
        return before[self.first], before[self.last], self.to[kept]

    def reached(self, starts: np.ndarray, depth: int, users: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """How many of `users_in` each start reaches in up to `depth` steps, itself left out; without any budget. All starts walk at
        once, a bit of a row each, from names to users and on to the names these declare; a name goes on once for each start."""
        n, declares = len(starts), (self.begin, self.begin + self.count, self.names)
        bits = np.zeros((n, -(-n // 64)), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        seen, active = np.zeros((len(self.first), bits.shape[1]), np.uint64), []
        at, rows = _led(starts, bits, *declares)
        for k in range(depth):
            rows &= ~seen[at]
            new = rows.any(axis=1)
            at, rows = at[new], rows[new]
            if not len(at):
                break
            seen[at] |= rows
            active.append(at)
            if k < depth - 1:
                at, rows = _led(*_led(at, rows, self.first, self.last, self.to), *declares)
        every = np.unique(np.concatenate(active)) if active else at
        found, rows = _led(every, seen[every], *users)
        if len(found):
            own = np.minimum(np.searchsorted(found, starts), len(found) - 1)
            mine = np.flatnonzero(found[own] == starts)
            rows[own[mine]] &= ~bits[mine]
        total = np.zeros(n, np.int64)
        for i in range(0, len(rows), 1 << 14):
            total += np.unpackbits(rows[i : i + (1 << 14)].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)[:n]
        return total


def _led(at: np.ndarray, bits: np.ndarray, first: np.ndarray, last: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All that the rows `at` lead to, to[first:last] each, once and in order, with the bits of the rows that lead there together."""
    size = last[at] - first[at]
    at, bits, size = at[size > 0], bits[size > 0], size[size > 0]
    out = np.zeros(0, np.int64), bits[:0]
    for cut in _some(size, max(1, (1 << 22) // bits.shape[1])):
        ends, row = to[ranges(first[at[cut]], size[cut])], np.repeat(np.arange(cut.start, cut.stop), size[cut])
        order = np.argsort(ends, kind="stable")
        some = _together(ends[order], bits[row[order]])
        if len(out[0]):
            ends = np.concatenate([out[0], some[0]])
            order = np.argsort(ends, kind="stable")
            some = _together(ends[order], np.concatenate([out[1], some[1]])[order])
        out = some
    return out


def _together(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the ids, which are in order, once, with the bits of all its rows."""
    begins = np.flatnonzero(np.diff(ids, prepend=-1))
    return ids[begins], np.bitwise_or.reduceat(bits, begins, axis=0)


def _flat(lists: pa.ChunkedArray) -> pa.ChunkedArray:
    return pa.chunked_array([c.flatten() for c in lists.chunks], lists.type.value_type)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] numbers, then those from first[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def batches(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; a column is an Arrow array, or a pair of one and the places to take from it."""
    n = len(columns[0][1] if isinstance(columns[0], tuple) else columns[0])
    for i in range(0, n, ROWS):
        cut = [c[0].take(pa.array(c[1][i : i + ROWS])) if isinstance(c, tuple) else pa.array(c[i : i + ROWS]) for c in columns]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cut, schema)], schema=schema)


def spread(rows: DataFrame, by: str) -> DataFrame:
    """`rows` over as many tasks as a shuffle has, by `by` and in its order, however small they are."""
    # By a hash, as a shuffle by the column itself would be taken for one that is there already, and few small rows put into one task.
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(by)).sortWithinPartitions(by)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame | None:
    """(start, id, depth) as `graph.reach` without its rows of depth 0; None if there are more edges than a worker holds."""
    path, n = stored(edges)
    if n > LIMIT:
        return None
    a, z = dict(starts.dtypes)["id"], dict(edges.dtypes)["b"]
    schema = pa.schema([("start", _arrow(a)), ("id", _arrow(z)), ("depth", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held(Net, path)
        for part in parts:
            at = net.index(part["id"])
            at = at[at >= 0]
            for i in range(0, len(at), WIDTH):
                some = at[i : i + WIDTH]
                for depth, start, node in net.levels(some):
                    yield from batches([(net.nodes, some[start]), (net.nodes, node), np.full(len(node), depth, np.int32)], schema)

    return spread(starts.select("id").distinct(), "id").mapInArrow(run, f"start {a}, id {z}, depth int")


def budgeted(starts: DataFrame, edges: DataFrame, depth: int, frontier: int, budget: int, keep: DataFrame) -> DataFrame | None:
    """(start, id, depth) as `graph.reach` with a budget, without its rows of depth 0, of the ids in `keep` only; None as in `closure`."""
    path, n = stored(edges, budget)  # no step goes over more edges of one node
    if n > LIMIT:
        return None
    return _walked(starts, Net, (path,), dict(edges.dtypes)["b"], depth, frontier, budget, keep, False)


def budgeted_by_name(starts: DataFrame, declared: DataFrame, used: DataFrame, depth: int, frontier: int, budget: int, keep: DataFrame, counted: bool = False) -> DataFrame | None:
    """As `budgeted` over the edges from each declarer (a, name) to all others that use (b, name) its name, without the edges; None if
    the rows don't fit a worker. `counted`: (start, n), how many are reached, of those that reach any."""
    table = kept(declared.select("a", "name").dropna().distinct())
    names = declared.sparkSession.read.parquet(table)
    # Of a name's users a step takes no more than its budget, besides the declarer itself.
    path, n = stored(used.select(F.col("name").alias("a"), "b").join(names.select(F.col("name").alias("a")), "a", "left_semi"), budget + 1)
    if n > LIMIT or names.count() > LIMIT:
        return None
    return _walked(starts, Named, (table, path), dict(used.dtypes)["b"], depth, frontier, budget, keep, counted)


def reached_by_name(starts: DataFrame, declared: DataFrame, used: DataFrame, depth: int, keep: DataFrame) -> DataFrame | None:
    """(start, n): how many ids of `keep` each start reaches in up to `depth` steps over all the edges of `budgeted_by_name`, itself left
    out, of those that reach any; None if the rows don't fit a worker."""
    table = kept(declared.select("a", "name").dropna().distinct())
    names = declared.sparkSession.read.parquet(table)
    path, n = stored(used.select(F.col("name").alias("a"), "b").join(names.select(F.col("name").alias("a")), "a", "left_semi"))
    if n > LIMIT or names.count() > LIMIT:
        return None
    wanted, a = kept(keep.select("id").distinct()), dict(starts.dtypes)["id"]
    schema = pa.schema([("start", _arrow(a)), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, users = held(Named, table, path), held(_users, table, path, wanted)
        # Rows of bits for all nodes and all names are kept within 64 MB.
        width = 64 * min(16, max(1, (1 << 23) // (len(net.nodes) + len(net.first) + 1)))
        for part in parts:
            at = net.index(part["id"])
            at = at[at >= 0]
            for i in range(0, len(at), width):
                some = at[i : i + width]
                n = net.reached(some, depth, users)
                yield from batches([(net.nodes, some[n > 0]), n[n > 0]], schema)

    return spread(starts.select("id").distinct(), "id").mapInArrow(run, f"start {a}, n bigint")


def _users(declared: str, used: str, wanted: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each name the users that are wanted."""
    net = held(Named, declared, used)
    good = np.zeros(len(net.nodes) + 1, bool)
    good[net.index(opened(wanted).to_table()["id"])] = True
    return net.users_in(good[:-1])


def _walked(starts: DataFrame, make: type[Net], paths: tuple[str, ...], z: str, depth: int, frontier: int, budget: int, keep: DataFrame, counted: bool) -> DataFrame:
    wanted, a = kept(keep.select("id").distinct()), dict(starts.dtypes)["id"]
    schema = pa.schema([("start", _arrow(a)), ("n", pa.int64())] if counted else [("start", _arrow(a)), ("id", _arrow(z)), ("depth", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held(make, *paths)
        good = np.zeros(len(net.nodes) + 1, bool)
        good[net.index(opened(wanted).to_table()["id"])] = True
        good[-1] = False
        seen, out, n = np.full(len(net.nodes), -1, np.int32), [], 0

        def send() -> Iterator[pa.RecordBatch]:
            c = [np.concatenate(x) for x in zip(*out)]
            return batches([(net.nodes, c[0]), c[1]] if counted else [(net.nodes, c[0]), (net.nodes, c[1]), c[2]], schema)

        for part in parts:
            at = net.index(part["id"])
            for s in at[at >= 0].tolist():
                levels = [(k, level[good[level]]) for k, level in net.budgeted(s, depth, frontier, budget, seen)]
                if counted:
                    total = sum(len(level) for _, level in levels)
                    rows = [([s], [total])] if total else []
                else:
                    rows = [(np.full(len(level), s), level, np.full(len(level), k, np.int32)) for k, level in levels]
                out += rows
                n += sum(len(x[0]) for x in rows)
                if n > ROWS:
                    yield from send()
                    out, n = [], 0
        if n:
            yield from send()

    return spread(starts.select("id").distinct(), "id").mapInArrow(run, f"start {a}, n bigint" if counted else f"start {a}, id {z}, depth int")


def _groups(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts equal codes together, and where each of the codes up to n begins in it and how often it is there."""
    size = np.bincount(codes, minlength=n) if len(codes) else np.zeros(n, np.int64)
    return np.argsort(codes, kind="stable"), np.cumsum(size) - size, size


class Members:
    """The graph of types with their members, grouped by what a lookup goes by: the columns `by` of the table (member, type, ...)."""

    def __init__(self, edges: str, types: str, table: str, by: tuple[str, ...]) -> None:
        t = opened(table).to_table(columns=["member", "type", *by]).combine_chunks()
        self.net = Net(edges, (types,))
        self.known = np.zeros(len(self.net.nodes), bool)
        self.known[self.net.index(opened(types).to_table()["id"])] = True
        code = np.zeros(len(t), np.int64)
        self.words = []
        for c in by:
            self.words.append(pc.unique(t[c]))
            place = _place(t[c], self.words[-1])
            code = np.unique(code * len(self.words[-1]) + place, return_inverse=True)[1] if len(by) > 1 else place
        self.code, self.member, self.type = code, t["member"].to_numpy(), self.net.index(t["type"])
        self.order, self.first, self.size = _groups(code, int(code.max(initial=-1)) + 1)

    def alike(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all members with one of the codes, the place in `codes` and the member's."""
        size = self.size[codes]
        return np.repeat(np.arange(len(codes)), size), self.order[ranges(self.first[codes], size)]


def _place(values: pa.ChunkedArray, words: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, value_set=words, skip_nulls=True), -1).to_numpy()


def _codes(values: pa.ChunkedArray, words: pa.Array) -> np.ndarray:
    """As `_place` for values with dictionaries, each word of which is looked up once; -1 for others."""
    chunks = [c for c in values.chunks if len(c.dictionary)]
    if not chunks:
        return np.full(len(values), -1, np.int32)
    codes = pc.fill_null(pc.index_in(pa.concat_arrays([c.dictionary for c in chunks]), value_set=words, skip_nulls=True), -1).to_numpy()
    parts, at = [], 0
    for c in values.chunks:
        own = np.append(codes[at : at + len(c.dictionary)], np.int32(-1))
        parts.append(own[pc.fill_null(c.indices, len(c.dictionary)).to_numpy()])
        at += len(c.dictionary)
    return np.concatenate(parts)


def _typed(members: DataFrame, supers: DataFrame, types: DataFrame, by: tuple[str, ...]) -> tuple[str, str, str] | None:
    path, n = stored(supers)
    table = kept(members.select("member", "type", *by).dropna())
    if n > LIMIT or members.sparkSession.read.parquet(table).count() > LIMIT // 4:
        return None
    return path, kept(types.select("id").filter("id IS NOT NULL").distinct()), table


def _some(places: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    """Slices of rows that bring `most` rows each, or one row; places has the number that each brings."""
    i, total = 0, np.cumsum(places)
    while i < len(places):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        yield slice(i, j)
        i = j


def overrides(members: DataFrame, supers: DataFrame, types: DataFrame) -> DataFrame | None:
    """`resolve.overrides` over the supertypes (a, b) of `types` (id), without the pairs of types; None if they don't fit a worker."""
    by = ("name", "kind", "arity")
    paths = _typed(members, supers, types, by)
    if paths is None:
        return None
    schema = pa.schema([("member", pa.int64()), ("overridden", pa.int64()), ("level", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(Members, *paths, by)
        order, first, size = held(_of_types, *paths, by)
        for part in parts:
            at = m.net.index(part["id"])
            at = at[(at >= 0)]
            for i in range(0, len(at), WIDTH):
                some = at[i : i + WIDTH]
                depths = m.net.depths(some)
                whose, mine = np.repeat(np.arange(len(some)), size[some]), order[ranges(first[some], size[some])]
                for cut in _some(m.size[m.code[mine]]):
                    k, other = m.alike(m.code[mine[cut]])
                    level = np.where(m.type[other] >= 0, depths[whose[cut][k], m.type[other]], -1)
                    hit = np.flatnonzero((level > 0) & (m.member[mine[cut][k]] != m.member[other]))
                    yield from batches([m.member[mine[cut][k[hit]]], m.member[other[hit]], level[hit].astype(np.int64)], schema)

    starts = types.select("id").join(supers.select(F.col("a").alias("id")), "id", "left_semi").distinct()
    return spread(starts, "id").mapInArrow(run, "member bigint, overridden bigint, level bigint")


def _of_types(edges: str, types: str, table: str, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the members of each node are."""
    m = held(Members, edges, types, table, by)
    order, first, size = _groups(m.type + 1, len(m.net.nodes) + 1)
    return order, first[1:], size[1:]


def member_lookup(uses: DataFrame, key: list[str], members: DataFrame, supers: DataFrame, types: DataFrame) -> DataFrame | None:
    """`resolve.member_lookup` over the supertypes (a, b) of `types` (id), without the pairs of types; None if they don't fit a worker.

    `uses` have the columns `key`, type and name, and each of them one type; out come `key`, member, level and nearest.
    """
    paths = _typed(members, supers, types, ("name",))
    if paths is None:
        return None
    kinds = dict(uses.dtypes)
    schema = pa.schema([*((c, _arrow(kinds[c])) for c in key), ("member", pa.int64()), ("level", pa.int64()), ("nearest", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(Members, *paths, ("name",))
        for part in parts:
            part = pa.Table.from_batches([part])
            at, word = m.net.index(part["type"]), _place(part["name"], m.words[0]) if len(m.words[0]) else np.full(len(part), -1)
            rows = np.flatnonzero((at >= 0) & (word >= 0))
            rows = rows[m.known[at[rows]]]
            every, keys = np.unique(at[rows]), {c: part[c].combine_chunks() for c in key}
            for i in range(0, len(every), WIDTH):
                some = every[i : i + WIDTH]
                depths = m.net.depths(some)
                mine = rows[np.isin(at[rows], some)]
                whose = np.searchsorted(some, at[mine])
                for cut in _some(m.size[word[mine]]):
                    k, other = m.alike(word[mine[cut]])
                    level = np.where(m.type[other] >= 0, depths[whose[cut][k], m.type[other]], -1)
                    hit = np.flatnonzero(level >= 0)
                    k, other, level = k[hit], other[hit], level[hit].astype(np.int64)
                    begins = np.flatnonzero(np.diff(k, prepend=-1))
                    least = np.repeat(np.minimum.reduceat(level, begins), np.diff(begins, append=len(k))) if len(k) else level
                    yield from batches([*((keys[c], mine[cut][k]) for c in key), m.member[other], level, level == least], schema)

    return spread(uses.select(*dict.fromkeys([*key, "type", "name"])).distinct(), "type").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", member bigint, level bigint, nearest boolean")


class Sides:
    """Pairs (task, path) from either side: the paths of task t are paths[of[t]:of[t + 1]], the tasks of path p tasks[on[p]:on[p + 1]]."""

    def __init__(self, table: str) -> None:
        t = opened(table).to_table(columns=["path", "tasks"])
        self.names, lists = t["path"].combine_chunks(), _flat(t["tasks"])
        self.ids = pc.unique(lists)
        size = pc.list_value_length(t["tasks"]).to_numpy().astype(np.int64)
        self.on, self.degree = np.concatenate([[0], np.cumsum(size)]), size
        self.tasks = _place(lists, self.ids) if len(lists) else np.zeros(0, np.int32)
        path = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order, first, count = _groups(self.tasks, len(self.ids))
        self.paths, self.of, self.count = path[order], first, count
        self.common = np.argsort(-size, kind="stable")
        self.falling = -size[self.common]
        self.total = np.concatenate([[0], np.cumsum(size[self.common])])

    def beside(self, task: int, least: int, of: int) -> tuple[np.ndarray, np.ndarray]:
        """The paths, not of the task, that at least `least` and one in `of` of the tasks on its paths touch, and how many of them do."""
        own = self.paths[self.of[task] : self.of[task] + self.count[task]]
        near = np.zeros(len(self.ids), bool)
        near[self.tasks[ranges(self.on[own], self.degree[own])]] = True
        near[task] = False
        tasks = np.flatnonzero(near)
        need = max(least, -(-len(tasks) // of))
        # Paths that fewer tasks touch at all can't be found, so either those are counted or all of the tasks' paths, whichever are fewer.
        k = int(np.searchsorted(self.falling, -need, side="right"))
        if self.total[k] < self.count[tasks].sum():
            some = self.common[:k]
            touched = near[self.tasks[ranges(self.on[some], self.degree[some])]]
            n = np.add.reduceat(touched, np.cumsum(self.degree[some]) - self.degree[some], dtype=np.int64) if k else np.zeros(0, np.int64)
        else:
            n = np.bincount(self.paths[ranges(self.of[tasks], self.count[tasks])], minlength=len(self.names))
            some = np.arange(len(n))
        hit = (n >= need) & ~np.isin(some, own)
        return some[hit], n[hit]


def co_changed(pairs: DataFrame, asked: DataFrame, least: int, of: int) -> DataFrame | None:
    """(asked, path, n): `Sides.beside` of the asked tasks (id) over distinct pairs (task, path); None if they don't fit a worker."""
    table = kept(pairs.filter("task IS NOT NULL AND path IS NOT NULL").groupBy("path").agg(F.collect_set("task").alias("tasks")))
    if pairs.sparkSession.read.parquet(table).agg(F.coalesce(F.sum(F.size("tasks")), F.lit(0))).first()[0] > LIMIT // 2:
        return None
    schema = pa.schema([("asked", pa.string()), ("path", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held(Sides, table)
        for part in parts:
            at = _place(pa.chunked_array([part["id"]]), x.ids) if len(x.ids) else np.zeros(0, int)
            for t in at[at >= 0].tolist():
                path, n = x.beside(t, least, of)
                yield from batches([(x.ids, np.full(len(path), t)), (x.names, path), n], schema)

    return spread(asked.select("id").distinct(), "id").mapInArrow(run, "asked string, path string, n bigint")


def best_alike(placed: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """(q, id, score, shared, in_title): of each question's documents all that can be among its `top` by score, rounded to 6 places.

    `terms` are (q, term, src), `placed` (term, id, own, part): what a word adds to a document's score. A task holds a share of the
    documents with all their words and goes through all questions; it sends on its best only, with those as good as the last of them.
    """
    asked = kept(terms.select("q", "term", "src"))
    schema = pa.schema([("q", pa.string()), ("id", pa.string()), ("score", pa.float64()), ("shared", pa.int64()), ("in_title", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if len(p)]
        if not parts:
            return
        t, rows = opened(asked).to_table().combine_chunks(), pa.Table.from_batches(parts)
        questions, words, ids = pc.unique(t["q"]), pc.unique(t["term"]), pc.unique(rows["id"])
        term, doc = _place(rows["term"], words), _place(rows["id"], ids)
        own, part = rows["own"].to_numpy().astype(np.int64), rows["part"].to_numpy()
        order, first, size = _groups(term, len(words))
        docs, adds = doc[order], part[order]
        of_doc, doc_first, doc_size = _groups(doc, len(ids))
        mine, src = _place(t["term"], words), t["src"].to_numpy()
        by_q, q_first, q_size = _groups(_place(t["q"], questions), len(questions))
        self_at = _place(pa.chunked_array([questions]), ids)
        out, n = [], 0
        weight, title = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for q in range(len(questions)):
            at = by_q[q_first[q] : q_first[q] + q_size[q]]
            score = np.zeros(len(ids))
            for w in mine[at].tolist():
                score[docs[first[w] : first[w] + size[w]]] += adds[first[w] : first[w] + size[w]]  # a document has a word once
            if self_at[q] >= 0:
                score[self_at[q]] = 0
            least = np.partition(score, len(score) - top)[len(score) - top] - 2e-6 if len(score) > top else 0
            best = np.flatnonzero((score > 0) & (score >= least))
            weight[mine[at]], title[mine[at]] = 1, src[at] == 0
            k, row = np.repeat(np.arange(len(best)), doc_size[best]), of_doc[ranges(doc_first[best], doc_size[best])]
            both = [np.bincount(k, own[row] * x[term[row]], len(best)).astype(np.int64) for x in (weight, title)]
            weight[mine[at]] = title[mine[at]] = 0
            out.append((np.full(len(best), q), best, score[best], *both))
            n += len(best)
            if n > ROWS or q == len(questions) - 1:
                c = [np.concatenate(x) for x in zip(*out)]
                yield from batches([(questions, c[0]), (ids, c[1]), *c[2:]], schema)
                out, n = [], 0

    words = terms.select("term").distinct()
    return spread(placed.join(words, "term", "left_semi"), "id").mapInArrow(run, "q string, id string, score double, shared bigint, in_title bigint")


class Callers:
    """From pairs (z, t), z declares t, and (t, x), x uses t, the x of each z but itself; the pairs (z, x) are never made."""

    def __init__(self, declared: str, used: str) -> None:
        d, u = opened(declared).to_table(columns=["z", "t"]), opened(used).to_table(columns=["t", "x"])
        types, zs, self.xs = pc.unique(u["t"]), pc.unique(d["z"]), pc.unique(u["x"])
        order, self.first, self.size = _groups(_place(u["t"], types), len(types))
        self.of_type = _place(u["x"], self.xs)[order]
        z, t = _place(d["z"], zs), _place(d["t"], types)
        order, self.begin, self.count = _groups(z[t >= 0], len(zs))
        self.of_z, self.z, self.known = t[t >= 0][order], {z: k for k, z in enumerate(zs.to_pylist())}, {}

    def of(self, name: str) -> list[str]:
        if name not in self.known:
            k = self.z.get(name)
            t = self.of_z[self.begin[k] : self.begin[k] + self.count[k]] if k is not None else self.of_z[:0]
            x = np.unique(self.of_type[ranges(self.first[t], self.size[t])])
            self.known[name] = [x for x in self.xs.take(pa.array(x)).to_pylist() if x != name]
        return self.known[name]


class Linked:
    """A share of the documents with the places of the words asked for and of links."""

    def __init__(self, docs: str, placed: str, links: str, words: str, share: int, shares: int) -> None:
        mine = ds.field("part_no").isin(range(share, PARTS, shares)) if shares > 1 else None
        t = opened(docs).to_table(columns=["id", "more", "updated"], filter=mine).combine_chunks()
        # In the order in which documents as good follow each other, so the place decides between them.
        t = t.take(pc.sort_indices(t, sort_keys=[("updated", "descending"), ("id", "ascending")], null_placement="at_end")).combine_chunks()
        self.ids, self.updated, self.more = t["id"].combine_chunks(), t["updated"].combine_chunks(), t["more"].to_numpy().astype(np.int64)
        terms = pc.unique(opened(words).to_table()["term"])
        self.term = {w: k for k, w in enumerate(terms.to_pylist())}
        # Counted first, then each put where it belongs, so that no more than the result and some files is held; in the end by place.
        whole, groups, n = opened(placed), [], ROWS << 4
        for f in whole.get_fragments():
            if n + f.count_rows() > ROWS << 4:
                groups.append([])
                n = 0
            groups[-1].append(f.path)
            n += f.count_rows()
        files = [ds.dataset(g, filesystem=whole.filesystem, format=ds.ParquetFileFormat(dictionary_columns=["term", "id"])) for g in groups]
        self.size = sum((np.bincount(_codes(f.to_table(columns=["term"], filter=mine)["term"], terms) + 1, minlength=len(terms) + 1)[1:] for f in files), np.zeros(len(terms), np.int64))
        self.first = np.cumsum(self.size) - self.size
        self.docs, self.parts, begin = np.zeros(self.size.sum(), np.int32), np.zeros(self.size.sum()), self.first.copy()
        for f in files:
            t = f.to_table(columns=["term", "id", "part"], filter=mine)
            w, at, part = _codes(t["term"], terms), _codes(t["id"], self.ids), t["part"].to_numpy()
            rows = np.flatnonzero((w >= 0) & (at >= 0))
            rows = rows[np.argsort(w[rows], kind="stable")]
            count = np.bincount(w[rows], minlength=len(terms))
            to = ranges(begin, count)
            self.docs[to], self.parts[to] = at[rows], part[rows]
            begin += count
        self.size = begin - self.first
        for i, j in zip(self.first.tolist(), begin.tolist()):
            order = np.argsort(self.docs[i:j])
            self.docs[i:j], self.parts[i:j] = self.docs[i:j][order], self.parts[i:j][order]
        t = opened(links).to_table(columns=["id", "kind", "what"], filter=mine)
        at, key = _place(t["id"], self.ids), pc.binary_join_element_wise(t["kind"], t["what"], " ")
        keys = pc.unique(key)
        order, self.begin, self.count = _groups(_place(key, keys)[at >= 0], len(keys))
        self.linked, self.key = at[at >= 0][order], {w: k for k, w in enumerate(keys.to_pylist())}
        self.score, self.bits = np.zeros(len(self.ids)), np.zeros(len(self.ids), np.uint8)
        pa.default_memory_pool().release_unused()

    def who(self, kind: str, what: str) -> np.ndarray:
        """The places of documents that have a link."""
        k = self.key.get(f"{kind} {what}")
        return self.linked[self.begin[k] : self.begin[k] + self.count[k]] if k is not None else self.linked[:0]

    def scores(self, asked: list[dict], me: int) -> np.ndarray:
        """The documents' scores by the words asked for, rounded to 6 places, without that of the asking one."""
        self.score[:] = 0
        for x in asked:
            if x["kind"] == "term" and (k := self.term.get(x["what"])) is not None:
                i, j = self.first[k], self.first[k] + self.size[k]
                self.score[self.docs[i:j]] += self.parts[i:j]  # a document has a word once
        if me >= 0:
            self.score[me] = 0
        return np.floor(self.score * 1e6 + 0.5) / 1e6

    def best(self, asked: list[dict], me: int, callers: Callers, worth: np.ndarray, bit: dict[str, int], most: float | None, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the `top` best, their scores and the links they have, as bits; `worth` is that of each set of links."""
        score, bits = self.scores(asked, me), self.bits
        most = score.max(initial=0) if most is None else most
        bits[:] = 0
        for x in asked:
            if x["kind"] != "term":
                bits[self.who(x["kind"], x["what"])] |= bit[x["kind"]]
            if x["kind"] == "file":
                bits[self.who("task", x["what"])] |= bit["task"]
                for name in callers.of(x["what"]):
                    bits[self.who("file", name)] |= bit["caller"]
                    bits[self.who("named", name)] |= bit["caller"]
        if me >= 0:
            bits[me] = 0
        rows = np.flatnonzero(bits)
        share = lambda x: np.floor(20 * x / most + 0.5).astype(np.int64) if most > 0 else np.zeros(len(x), np.int64)
        # The least link is worth more than all text and votes, so others count only if too few have links.
        if len(rows) < top and most > 0:
            rows = np.flatnonzero((bits > 0) | (20 * score / most + 0.5 >= 1))
        total = worth[bits[rows]] + share(score[rows]) + self.more[rows]
        if len(rows) > top:
            least = np.partition(total, len(rows) - top)[len(rows) - top]
            over, even = np.flatnonzero(total > least), np.flatnonzero(total == least)
            keep = np.concatenate([over, even[: top - len(over)]])
            rows, total = rows[keep], total[keep]
        return rows, total, bits[rows]


def best_linked(docs: DataFrame, placed: DataFrame, links: DataFrame, asked: DataFrame, declared: DataFrame, used: DataFrame, worth: dict[str, tuple[str, int]], top: int) -> DataFrame:
    """(q, id, score, tiers, updated): of each question's documents those that can be among its `top` best by links, then by text and votes.

    `docs` are (id, more, updated), `placed` (term, id, part): what a word adds to a document's text score; `links` (id, kind, what), of
    the kind task for the names of files that a task landed on; `asked` (q, kind, what), of the kind term for words. A file's callers
    are what `Callers` makes of `declared` and `used`. `worth` has the tier and the value of each kind; the best value counts, each
    further tier 5 more, both a hundredfold; text up to 20, as a part of the question's greatest; and `more`.

    A task takes a share of the questions and holds the documents, or a share of them if they have more than `SHARE` places, and sends
    on its best only: nothing is kept by pairs of a question and a document.
    """
    spark, n = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = lambda df: kept(df.filter("id IS NOT NULL").withColumn("part_no", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")))
    paths = (split(docs.select("id", "more", "updated")), split(placed.select("term", "id", "part")), split(links.select("id", "kind", "what").distinct()))
    paths += (kept(asked.filter("kind = 'term'").select(F.col("what").alias("term")).distinct()),)
    shares = min(PARTS, max(1, -(-spark.read.parquet(paths[1]).count() // SHARE)))
    pairs = kept(declared.select("z", "t").dropna().distinct()), kept(used.select("t", "x").dropna().distinct())
    rows = asked.filter("q IS NOT NULL").distinct().groupBy("q").agg(F.collect_list(F.struct("kind", "what")).alias("asked"))
    rows = spark.read.parquet(kept(rows.select("q", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "asked")))
    bit = {k: 1 << i for i, k in enumerate(worth)}
    sets = [[worth[k] for k in worth if bit[k] & i] for i in range(1 << len(bit))]
    tiers = np.array([len({t for t, _ in x}) for x in sets])
    value = np.array([100 * (max(v for _, v in x) + 5 * (len({t for t, _ in x}) - 1)) if x else 0 for x in sets])
    schema = pa.schema([("q", pa.string()), ("id", pa.string()), ("score", pa.int64()), ("tiers", pa.int64()), ("updated", pa.int64())])

    def each(part: pa.RecordBatch) -> Iterator[tuple[dict, Linked, int]]:
        x, names, of = None, part["q"], part["share"].to_pylist()
        for k, row in enumerate(part.to_pylist()):
            if not k or of[k] != of[k - 1]:
                x = held(Linked, *paths, of[k], shares)
                at = _place(pa.chunked_array([names]), x.ids)
            yield row, x, int(at[k])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, x, me in each(part):
                at, total, bits = x.best(row["asked"], me, held(Callers, *pairs), value, bit, row.get("most"), top)
                q = pa.array([row["q"]] * len(at), pa.string())
                yield pa.RecordBatch.from_arrays([q, x.ids.take(pa.array(at)), pa.array(total), pa.array(tiers[bits]), x.updated.take(pa.array(at))], schema=schema)

    def greatest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [(row["q"], float(x.scores(row["asked"], me).max(initial=0))) for row, x, me in each(part)]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.string()), pa.array([m for _, m in found], pa.float64())], names=["q", "most"])

    # By ranges, so that a task has few shares, or one.
    apart = lambda df: df.repartitionByRange(n, "share", "q").sortWithinPartitions("share", "q")
    if shares > 1:
        most = kept(apart(rows).mapInArrow(greatest, "q string, most double").groupBy("q").agg(F.max("most").alias("most")))
        rows = rows.join(spark.read.parquet(most), "q")
    return apart(rows).mapInArrow(run, "q string, id string, score bigint, tiers bigint, updated bigint")
