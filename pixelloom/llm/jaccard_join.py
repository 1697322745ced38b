"""N-gram Jaccard join by vertical partitioning.

Shingles have one global order, rare ones first; the order is cut into fragments, and work on a document's shingles
is dealt out by fragment:

1. *Order.* Equal sets have equal signatures and are one node from here on. Shingles go to tasks by ranges of their hash, where
   the nodes that hold each are counted; shingles of a single node end there, the others go back to their nodes with the
   counts. The order is by (class of the count, hash). Shingles of about a thousandth of all nodes or more, of which there
   are at most MOST_HOT, are known from the first reading and skip the counting, so no task gets their lists.
2. *Candidates.* Only nodes can have a partner that share as much of their set as the similarity asks for; their shared
   shingles are written once and texts are not read again. Two sets as alike as asked share a shingle of their prefixes.
   Prefixes go to their fragments, where the shingles' lists give pairs that pass the length and position filters, and
   how many shingles each pair shares there; the sum over fragments must leave a chance to reach the similarity. A list of
   more than LONG nodes gives only pairs with its first LEADERS nodes, and is remembered; one of more than SPLIT nodes is
   dealt to several tasks, whose leaders are held against each other.
3. *Overlaps.* The sets of the nodes in pairs are cut at the fragments' bounds; partial overlaps are counted for each
   fragment on its own and summed per pair, and the exact test decides.
4. *Long lists.* Their nodes are mostly connected by now. Lists that share nodes form a cell; its nodes outside the
   cell's largest component are held against all of its nodes, in blocks, again fragment by fragment, and only links
   that connect are returned. So no pair of a large group is ever listed, and no link between components is lost.
5. Connected components, and back to documents.

Texts are read twice and never shuffled. What is shuffled are the shingles, packed, once, and then those that nodes share. A shingle
takes 8 bytes, and its node 8 more unless another shingle of the node goes to the same group: the more groups there are, the rarer that is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import cut, fresh_path, table, temporary, text_or_empty, tidied, written
from .components import components

WIDTH, PERCENT = 5, 80
#: Shingles that a task packs at once, shingles to a counting group, groups to a task, and the least number of groups.
HELD, PER_COUNT, GROUPS, LEAST_GROUPS = 1_000_000, 2_000_000, 2, 64
#: A shingle is hot in a packed run with so many nodes there, and hot at all from a share of the nodes and a number of them on.
HOT_IN_RUN, HOT_SHARE, HOT_LEAST, MOST_HOT = 4, 1 / 1000, 1000, 1 << 20
#: Counts up to EXACT are classes of their own, larger ones have STEPS classes to a doubling.
EXACT, STEPS = 4096, 1024
#: Prefix shingles to a fragment, and the least number of fragments.
PER_FRAGMENT, LEAST_FRAGMENTS = 400_000, 32
LONG, LEADERS, SPLIT = 32, 4, 50_000
#: Meetings of two sets that a task holds before it sums them up.
MOST_MET = 1_000_000
#: Fragments in which overlaps are counted, shingles to a counting task, nodes to a block of a cell.
CUTS, PER_TASK, BLOCK = 4, 2_000_000, 512
SALTS = 16
NO_SHINGLES = np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, one of none has none."""
    data = tb.LOWER[data]
    starts, ends, row = tb.words(data, offsets)
    h = tb.Hashes(data).of(starts, ends)
    n = len(offsets) - 1
    wh, at = tb.windows(h, row, width)
    of_words = np.searchsorted(row, np.arange(n + 1))
    of_windows = np.searchsorted(row[at], np.arange(n + 1))
    out = []
    for k in range(n):
        if of_windows[k] < of_windows[k + 1]:
            out.append(np.unique(wh[of_windows[k] : of_windows[k + 1]]))
        elif of_words[k] < of_words[k + 1]:
            few = h[of_words[k] : of_words[k + 1]]
            whole, _ = tb.windows(few, np.zeros(len(few), np.int64), len(few))
            out.append(tb.mixed(whole + np.uint64(len(few))))
        else:
            out.append(NO_SHINGLES)
    return out


def signature(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _classes(counts: np.ndarray) -> np.ndarray:
    """Classes of counts, in their order: a function of the count alone, below 2**16."""
    large = EXACT + np.floor(STEPS * np.log2(np.maximum(counts, 1) / EXACT))
    return np.where(counts < EXACT, counts, np.minimum(large, 65535)).astype(np.uint16)


def _count_of(classes: np.ndarray) -> np.ndarray:
    """About the counts of classes, not below them by more than a rounding."""
    c = classes.astype(np.float64)
    return np.where(c < EXACT, c, EXACT * np.exp2((np.maximum(c, EXACT) + 1 - EXACT) / STEPS))


def _places(classes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Shingles' places in the global order, as 64-bit keys."""
    return (classes.astype(np.uint64) << np.uint64(48)) | (tokens >> np.uint64(16))


def _quantiles(mass: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Keys below which the given shares of a mass by class lie; within a class, hashes are even."""
    total = np.concatenate([[0], np.cumsum(mass)])
    want = np.asarray(shares) * total[-1]
    c = np.clip(np.searchsorted(total, want, "right") - 1, 0, len(mass) - 1)
    inside = np.where(mass[c] > 0, (want - total[c]) / np.maximum(mass[c], 1), 0)
    return (c.astype(np.uint64) << np.uint64(48)) | (np.clip(inside, 0, 1 - 1e-9) * 2.0**48).astype(np.uint64)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _node_of(sigs: np.ndarray) -> np.ndarray:
    """The short number of nodes, the first 64 bits of their signatures."""
    return sigs.view("<u8").reshape(-1, 2)[:, 0]


def _prefix(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def _texts(batch: pa.RecordBatch, width: int):
    """(row, set) of a batch's texts, whose column comes last."""
    for a, _, data, offs in tb.text_runs(batch.column(batch.num_columns - 1)):
        yield from enumerate(shingle_sets(data, offs, width), a)


def _signed(given: DataFrame, width: int) -> DataFrame:
    """(keys.., n, sig, node) of every document, and rows (hot, many) with the shingles that many nodes of a run hold."""
    names = [c for c in given.columns if c != "text"] + ["n", "sig", "node", "hot", "many"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "text") + ", n bigint, sig binary, node bigint, hot binary, many binary"

    def run(batches):
        seen, held, size = set(), [], 0

        def flush(keys):
            tokens = np.sort(np.concatenate(held))
            at = _edges(tokens)
            many = np.diff(np.append(at, len(tokens))).astype(np.int32)
            often = many >= HOT_IN_RUN
            none = [pa.nulls(1, c.type) for c in keys] + [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array([tokens[at][often].tobytes()], pa.binary()), pa.array([many[often].tobytes()], pa.binary())], names)

        for batch in batches:
            n, sigs, keys = [], [], batch.columns[:-1]
            for _, s in _texts(batch, width):
                n.append(len(s))
                sigs.append(signature(s))
                if len(s) and sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    held.append(s)
                    size += len(s)
                if size >= HELD:
                    yield flush(keys)
                    held, size = [], 0
            nodes = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in sigs]
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(nodes, pa.int64()), none, none], names)
        if held:
            yield flush(keys)

    return given.mapInArrow(lambda b: tidied(run(b)), ddl)


def _hot_shingles(signed: DataFrame, n_nodes: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles, sorted, and their classes: a choice and an order that all tasks share. Their number is below
    MOST_HOT at any size, as each is counted so often that no more fit into all sets together."""

    def run(batches):
        for batch in batches:
            for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(m, np.int32).astype(np.int64))], ["token", "n"])

    least = max(HOT_LEAST, int(n_nodes * HOT_SHARE), -(-total // MOST_HOT))
    sums = signed.filter("hot is not null").select("hot", "many").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sums.filter(F.col("n") >= least).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], _classes(rows["n"].to_numpy(np.int64)[order])


def _grouped_rows(group: np.ndarray, owner: np.ndarray, *values: np.ndarray):
    """(group, places of owners' first values, values of each owner, slice of values) of each group; group is sorted, and
    owners within it."""
    first = _edges(group, owner)
    if not len(first):
        return
    many = np.diff(np.append(first, len(group))).astype(np.int32)
    starts = np.searchsorted(first, _edges(group))
    for a, b in zip(starts, np.append(starts[1:], len(first)), strict=True):
        yield int(group[first[a]]), first[a:b], many[a:b], slice(first[a], first[b] if b < len(first) else len(group))


def _dealt(given: DataFrame, width: int, n_tasks: int, hot) -> DataFrame:
    """Sets by range of the hash, packed: nodes, numbers of shingles, shingles; and, with classes, each node's hot ones."""
    names = ["part", "nodes", "many", "tokens", "classes"]

    def run(batches):
        known, classes = hot.value
        seen, held, size = set(), [], 0

        def flush():
            node = np.concatenate([np.full(len(s), n, np.uint64) for n, s in held])
            token = np.concatenate([s for _, s in held])
            cols = [[] for _ in names]
            place = np.minimum(np.searchsorted(known, token), max(0, len(known) - 1))
            is_hot = known[place] == token if len(known) else np.zeros(len(token), bool)
            for chosen in (~is_hot, is_hot):
                n, t, p = node[chosen], token[chosen], place[chosen]
                passing = chosen is is_hot
                part = (((n if passing else t) >> np.uint64(32)) * np.uint64(n_tasks)) >> np.uint64(32)
                order = np.lexsort((n, part))
                part, n, t, p = part[order], n[order], t[order], p[order]
                for g, at, many, sl in _grouped_rows(part, n):
                    said = classes[p[sl]].tobytes() if passing else None
                    for c, v in zip(cols, (g, n[at].tobytes(), many.tobytes(), t[sl].tobytes(), said), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(cols)], names)

        for batch in batches:
            for _, s in _texts(batch, width):
                sig = signature(s)
                if sig is None or sig in seen:
                    continue
                seen.add(sig)
                held.append((np.uint64(int.from_bytes(sig[:8], "little")), s))
                size += len(s)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return given.select("text").mapInArrow(lambda b: tidied(run(b)), "part bigint, nodes binary, many binary, tokens binary, classes binary")


def _joined(rows, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in rows.column(name)), kind)


def _counted(n_homes: int):
    """For a range of hashes: shingles of two or more nodes and their classes, packed by the home of the nodes."""

    def run(rows):
        passing = pc.is_valid(rows.column("classes"))
        cold = rows.filter(pc.invert(passing))
        token, node = _joined(cold, "tokens", np.uint64), np.repeat(_joined(cold, "nodes", np.uint64), _joined(cold, "many", np.int32))
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        at = _edges(token, node)  # a node met in several tasks counts once
        token, node = token[at], node[at]
        begins = _edges(token)
        many = np.diff(np.append(begins, len(token)))
        classes = np.repeat(_classes(many), many)
        shared = np.repeat(many > 1, many)
        warm = rows.filter(passing)
        token = np.concatenate([token[shared], _joined(warm, "tokens", np.uint64)])
        node = np.concatenate([node[shared], np.repeat(_joined(warm, "nodes", np.uint64), _joined(warm, "many", np.int32))])
        classes = np.concatenate([classes[shared], _joined(warm, "classes", np.uint16)])
        home = node.view(np.int64) % n_homes
        order = np.lexsort((node, home))
        home, node, token, classes = home[order], node[order], token[order], classes[order]
        cols = [[] for _ in range(5)]
        for g, first, n, sl in _grouped_rows(home, node):
            for c, v in zip(cols, (g, node[first].tobytes(), n.tobytes(), token[sl].tobytes(), classes[sl].tobytes()), strict=True):
                c.append(v)
        return pa.table([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(cols)], ["home", "nodes", "many", "tokens", "classes"])

    return run


def _assembled(percent: int):
    """For a home's nodes: their shared shingles in the global order, where these are enough for a partner."""

    def run(nodes, rows):
        node = np.repeat(_joined(rows, "nodes", np.uint64), _joined(rows, "many", np.int32))
        token, classes = _joined(rows, "tokens", np.uint64), _joined(rows, "classes", np.uint16)
        order = np.lexsort((token, _places(classes, token), node))
        node, token, classes = node[order], token[order], classes[order]
        at = _edges(node, token)  # hot ones come from each task that met the node
        node, token, classes = node[at], token[at], classes[at]
        wanted = nodes.column("node").to_numpy().view(np.uint64)
        a, b = np.searchsorted(node, wanted), np.searchsorted(node, wanted, "right")
        n = nodes.column("n").to_numpy()
        keep = np.flatnonzero((b > a) & (100 * (b - a) >= percent * n))
        cols = [[token[a[k] : b[k]].tobytes() for k in keep], [classes[a[k] : b[k]].tobytes() for k in keep]]
        return pa.table([nodes.column("sig").take(pa.array(keep)), pa.array(n[keep]), *[pa.array(c, pa.binary()) for c in cols]], ["sig", "n", "tokens", "classes"])

    return run


def _sets(batches):
    """(sig, n, shingles, classes) of the rows of batches with columns in that order."""
    for batch in batches:
        cols = [batch.column(k) for k in range(4)]
        yield [(s.as_py(), n.as_py(), np.frombuffer(t.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint16)) for s, n, t, c in zip(*cols, strict=True)]


def _masses(kept: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of prefixes, and of all kept sets, are in each class."""

    def run(batches):
        mass = np.zeros((2, 1 << 16), np.int64)
        for sets in _sets(batches):
            for _, n, t, c in sets:
                mass[0] += np.bincount(c[: _prefix(n, percent) - (n - len(t))], minlength=1 << 16)
                mass[1] += np.bincount(c, minlength=1 << 16)
        at = np.flatnonzero(mass[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass[0][at]), pa.array(mass[1][at])], ["class", "prefix", "whole"])

    rows = kept.mapInArrow(lambda b: tidied(run(b)), "class bigint, prefix bigint, whole bigint").groupBy("class").agg(F.sum("prefix"), F.sum("whole")).collect()
    out = np.zeros((2, 1 << 16), np.int64)  # a row for each class at most
    for k, x, y in rows:
        out[:, k] = x, y
    return out[0], out[1]


def _fragments(kept: DataFrame, percent: int, pivots: np.ndarray) -> DataFrame:
    """Prefixes by fragment, packed: signatures, sizes, first places and numbers of shingles, and the shingles.

    Shingles of more than SPLIT nodes are no fragment's; each has tasks of its own, with negative numbers, by its nodes.
    """
    names = ["frag", "sigs", "sizes", "places", "many", "tokens"]

    def run(batches):
        held, size = [], 0

        def flush():
            sigs = np.frombuffer(b"".join(h[0] for h in held), "V16")
            sizes, length = np.array([h[1] for h in held], np.int32), [len(h[3]) for h in held]
            doc = np.repeat(np.arange(len(held)), length)
            place = np.concatenate([np.arange(h[2], h[2] + len(h[3])) for h in held]).astype(np.int32)
            token, classes = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            frag = np.searchsorted(pivots, _places(classes, token), "right").astype(np.int64)
            n_split = -(-_count_of(classes) // SPLIT)
            salt = _node_of(sigs)[doc] % n_split.astype(np.uint64)
            apart = -1 - (tb.mixed(token ^ tb.mixed(salt)) >> np.uint64(2)).astype(np.int64)
            frag = np.where(n_split > 1, apart, frag)
            # a fragment's documents, and of each document its run of places; split shingles of a document are runs of one
            order = np.lexsort((place, doc, frag))
            frag, doc, place, token = frag[order], doc[order], place[order], token[order]
            cols = [[] for _ in names]
            run_no = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])) if len(doc) else doc
            for g, first, many, sl in _grouped_rows(frag, run_no):
                d = doc[first]
                for c, v in zip(cols, (g, sigs[d].tobytes(), sizes[d].tobytes(), place[first].tobytes(), many.tobytes(), token[sl].tobytes()), strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(cols)], names)

        for sets in _sets(batches):
            for sig, n, t, c in sets:
                alone = n - len(t)  # shingles of no other set come first in the order
                end = _prefix(n, percent) - alone
                held.append((sig, n, alone, t[:end], c[:end]))
                size += end
                if size >= PER_FRAGMENT:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return kept.mapInArrow(lambda b: tidied(run(b)), "frag bigint, sigs binary, sizes binary, places binary, many binary, tokens binary")


PAIR_DDL = "list bigint, h bigint, c bigint, a binary, b binary, na bigint, nb bigint, star boolean"


def _paired(percent: int):
    """For a fragment, rows of three kinds: pairs of signatures (h, c, a, b, na, nb, star) that pass the filters, with
    the number c of prefix shingles that they share here; (h, c) alone of pairs that share some but pass no filter here; and
    nodes of long lists (list, a, na; star marks the leaders of a part of a split list). h stands for the pair wherever it
    is met."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in PAIR_DDL.split(", ")]

    def out(n, **cols):
        return pa.table([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in zip(names, kinds, strict=True)], names)

    def run(rows):
        cat = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), kind)
        raw, many = cat("sigs", "V16"), cat("many", np.int32)
        keys = raw.view(">u8").reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(1)])
        node = np.empty(len(raw), np.int64)
        node[order] = np.cumsum(new) - 1
        sig, size = raw[order[new]], cat("sizes", np.int32)[order[new]].astype(np.int64)
        token, owner = cat("tokens", np.uint64), np.repeat(node, many)
        place = np.repeat(cat("places", np.int32).astype(np.int64), many) + np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
        order = np.lexsort((owner, token))
        token, owner, place = token[order], owner[order], place[order]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner, place = token[fresh], owner[fresh], place[fresh]
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(begins, len(token)))
        met = [np.zeros((0, 3), np.int64)]  # pair, shared shingles, filters passed (1) and star (2)

        def packed():
            """met as one array with a row for each pair."""
            got = np.concatenate(met)
            got = got[np.argsort(got[:, 0], kind="stable")]
            at = np.flatnonzero(np.concatenate([[True], got[1:, 0] != got[:-1, 0]])) if len(got) else np.zeros(0, int)
            if not len(at):
                return got
            return np.stack([got[at, 0], np.add.reduceat(got[:, 1], at), np.bitwise_or.reduceat(got[:, 2], at)], 1)

        def keep(i, j, star):
            a, b = owner[i], owner[j]
            na, nb = size[a], size[b]
            near = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            passed = np.minimum(na - place[i], nb - place[j]) >= -(-percent * (na + nb) // (100 + percent))
            pair = np.minimum(a, b) << 32 | np.maximum(a, b)
            met.append(np.stack([pair, np.ones(len(pair), np.int64), passed * (1 + 2 * star)], 1)[near])
            if sum(map(len, met)) > MOST_MET:
                met[:] = [packed()]

        split = rows.column("frag")[0].as_py() < 0
        long = (length > LONG) | split
        i = np.flatnonzero(np.repeat((length > 1) & ~long, length))
        for step in range(1, LONG):
            i = i[i + step < len(token)]
            i = i[token[i + step] == token[i]]
            if not len(i):
                break
            keep(i, i + step, 0)
        lists = [[], [], [], []]
        for b, n in zip(begins[long].tolist(), length[long].tolist(), strict=True):
            for k in range(min(n, LEADERS)):
                keep(np.full(n - k - 1, b + k), np.arange(b + k + 1, b + n), 1)
            who = owner[b : b + n]
            lists[0] += [int(token[b].view(np.int64))] * n
            lists[1] += [x.tobytes() for x in sig[who]]
            lists[2] += size[who].tolist()
            lists[3] += [split and k < LEADERS for k in range(n)]
        got = packed()
        a, b = got[:, 0] >> 32, got[:, 0] & 0xFFFFFFFF
        two = sig.view(">u8").reshape(-1, 2).astype(np.uint64)
        h = tb.mixed(two[a, 0] ^ tb.mixed(two[a, 1] ^ tb.mixed(two[b, 0] ^ tb.mixed(two[b, 1])))).view(np.int64)
        full = got[:, 2] > 0
        pairs = out(int(full.sum()), h=h[full], c=got[full, 1], a=[x.tobytes() for x in sig[a[full]]], b=[x.tobytes() for x in sig[b[full]]], na=size[a[full]], nb=size[b[full]], star=got[full, 2] > 1)
        light = out(int((~full).sum()), h=h[~full], c=got[~full, 1])
        return pa.concat_tables([pairs, light, out(len(lists[0]), list=lists[0], a=lists[1], na=lists[2], star=lists[3])])

    return run


def _candidates(found: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of the pairs that can be alike by what their prefixes share, and of leaders of the parts of a list.

    Beyond the shared prefix shingles only the larger of the two rests can add to the overlap. Pairs of a long list are not
    counted in full there; those with its leaders stay, and all others of the list are looked at again later.
    """
    sums = found.filter("h is not null").groupBy("h").agg(F.sum("c").alias("c"))
    full = found.filter("b is not null").groupBy("a", "b", "h").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("star").alias("star"))
    rest = f"({percent} * greatest(na, nb) + 99) div 100 - 1"
    need = f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"
    near = full.join(sums, "h").filter(f"star or c + {rest} >= {need}").select("a", "b", "na", "nb")
    heads = found.filter("list is not null and star").select("list", "a", "na")
    if heads.isEmpty():
        return near
    # the leaders of a list's parts against its first ones: a row for each, not for each pair of them
    first = heads.groupBy("list").agg(F.slice(F.array_sort(F.collect_set(F.struct("a", "na"))), 1, LEADERS).alias("first"))
    across = heads.join(first, "list").select(F.explode("first").alias("x"), "a", "na").filter(f"a != x.a and 100 * least(na, x.na) >= {percent} * greatest(na, x.na)")
    across = across.select(F.least("a", "x.a").alias("a"), F.greatest("a", "x.a").alias("b"), F.expr("if(a < x.a, na, x.na)").alias("na"), F.expr("if(a < x.a, x.na, na)").alias("nb"))
    return near.unionByName(across).distinct()


def _cut_sets(kept: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(sig, f0, f1, ..): the shared shingles of nodes, cut at the fragments' bounds."""

    def run(batches):
        for sets in _sets(batches):
            rows = [[] for _ in range(CUTS + 1)]
            for sig, _, t, c in sets:
                at = [0, *np.searchsorted(_places(c, t), cuts).tolist(), len(t)]
                rows[0].append(sig)
                for k in range(CUTS):
                    rows[k + 1].append(np.sort(t[at[k] : at[k + 1]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()) for r in rows], ["sig", *[f"f{k}" for k in range(CUTS)]])

    return kept.mapInArrow(lambda b: tidied(run(b)), "sig binary, " + ", ".join(f"f{k} binary" for k in range(CUTS)))


def _partial(sets, pairs):
    """Overlaps of pairs within one fragment."""
    held = dict(zip((x.as_py() for x in sets.column("sig")), (np.frombuffer(x.as_py(), np.uint64) for x in sets.column("tokens")), strict=True))
    a, b, n = pairs.column("a"), pairs.column("b"), []
    for x, y in zip(a, b, strict=True):
        both = np.concatenate([held[x.as_py()], held[y.as_py()]])
        both.sort()
        n.append(int((both[1:] == both[:-1]).sum()))
    return pa.table({"a": a, "b": b, "na": pairs.column("na"), "nb": pairs.column("nb"), "n": pa.array(n, pa.int64())})


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, n_tasks: int) -> DataFrame:
    """(u, v) of the pairs alike enough. A task gets the sets of its pairs once each, cut by fragment."""
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    ends = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
    info = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"), F.count("*").alias("degree"))
    crowd = info.groupBy("label").agg((1 + F.expr(f"count(*) div {BLOCK}")).alias("blocks"))
    info = info.join(crowd, "label")
    for side in ("a", "b"):
        own = info.select(F.col("u").alias(side), F.struct(F.col("degree").alias("degree"), F.col("u").alias("u"), "label", "blocks").alias(f"at_{side}"))
        pairs = pairs.join(own, side)
    home = F.least("at_a", "at_b")  # the end with fewer pairs; its crowd's block does the counting
    pairs = pairs.withColumn("home", home).withColumn(
        "task", F.pmod(F.xxhash64("home.label", F.pmod(F.xxhash64("home.u"), F.col("home.blocks"))), F.lit(n_tasks)).cast("int")
    )
    pairs = cut(pairs.select("task", "a", "b", "na", "nb"))
    need = pairs.select("task", F.col("a").alias("sig")).unionByName(pairs.select("task", F.col("b").alias("sig"))).distinct()
    stacked = ", ".join(f"{k}, f{k}" for k in range(CUTS))
    parts = need.join(sets, "sig").selectExpr("task", "sig", f"stack({CUTS}, {stacked}) as (frag, tokens)")
    asked = pairs.select(F.col("task").alias("at_task"), F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))).alias("at_frag"), "a", "b", "na", "nb")
    counted = parts.groupBy("task", "frag").cogroup(asked.groupBy("at_task", "at_frag")).applyInArrow(_partial, "a binary, b binary, na bigint, nb bigint, n bigint")
    summed = counted.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("n").alias("n"))
    return summed.filter(f"100 * n >= {percent} * (na + nb - n)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _incidence(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(columns)), np.float32)
    for k, r in enumerate(rows):
        at = np.searchsorted(columns, r)
        at = at[(at < len(columns))]
        hit = columns[at] == r[: len(at)]
        out[k, at[hit]] = 1
    return out


def _cell_links(percent: int):
    """For a block of a cell's strays and one of its nodes: links (u, v) that connect their components' roots."""

    def run(rows):
        stray = np.array(rows.column("stray").to_pylist(), bool)
        roots, sizes = rows.column("root").to_pylist(), np.array(rows.column("n").to_pylist(), np.int64)
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        overlap = np.zeros((len(left), len(right)), np.float32)
        for k in range(CUTS):
            s = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column(f"f{k}")]
            one, two = [s[i] for i in left], [s[i] for i in right]
            shared = np.intersect1d(np.concatenate([*one, NO_SHINGLES]), np.concatenate([*two, NO_SHINGLES]))
            for c in range(0, len(shared), 4096):
                columns = shared[c : c + 4096]
                overlap += _incidence(one, columns) @ _incidence(two, columns).T
        n = np.rint(overlap).astype(np.int64)
        alike = 100 * n >= percent * (sizes[left][:, None] + sizes[right][None, :] - n)
        parent: dict[bytes, bytes] = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for i, j in zip(*np.nonzero(alike), strict=True):
            u, v = top(roots[left[i]]), top(roots[right[j]])
            if u != v:
                parent[u] = v
                links.append((roots[left[i]], roots[right[j]]))
        return pa.table({"u": pa.array([x[0] for x in links], pa.binary()), "v": pa.array([x[1] for x in links], pa.binary())})

    return run


def _long_list_links(lists: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between components of ``known`` (node, root) whose nodes share a long list."""
    first = lists.groupBy("list").agg(F.min("a").alias("u"))
    cells = components(lists.join(first, "list").select("u", F.col("a").alias("v")))
    nodes = lists.select(F.col("a").alias("node"), F.col("na").alias("n")).distinct()
    nodes = nodes.join(cells.withColumnRenamed("root", "cell"), "node").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = cut(nodes)
    by_root = nodes.groupBy("cell", "root").count()
    main = by_root.groupBy("cell").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("m"), (F.sum("count") - F.max("count")).alias("x"))
    nodes = nodes.join(main.filter("x > 0"), "cell")
    blocks = lambda c: F.expr(f"cast(1 + {c} div {BLOCK} as int)")
    row = nodes.select("cell", F.col("node").alias("sig"), "n", "root", "main", blocks("m").alias("mb"), blocks("x").alias("xb"))
    place = lambda c: F.pmod(F.xxhash64("sig"), F.col(c)).cast("int")
    others = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    every = row.select("cell", place("mb").alias("p"), others("xb").alias("q"), "sig", "n", "root", F.lit(False).alias("stray"))
    strays = row.filter("root != main").select("cell", others("mb").alias("p"), place("xb").alias("q"), "sig", "n", "root", F.lit(True).alias("stray"))
    return every.unionByName(strays).join(sets, "sig").groupBy("cell", "p", "q").applyInArrow(_cell_links(percent), "u binary, v binary")


def _named_nodes(given: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (keys.., n, sig) of given (keys.., text), and the nodes (sig, copies, rep, root); rep is the least of the keys as
    a struct, those without a doc_id last."""
    spark = given.sparkSession
    keys = [c for c in given.columns if c != "text"]
    signed = written(_signed(given, width), "signed")
    rows = signed.filter("hot is null").select(*keys, "n", "sig")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *keys)).alias("rep")
    nodes = signed.filter("sig is not null").groupBy("sig").agg(F.min("node").alias("node"), F.min("n").alias("n"), rep, F.count("*").alias("copies"))
    nodes = cut(nodes)
    named, path = nodes.select("sig", "copies", "rep", F.col("sig").alias("root")), fresh_path(spark, "named")
    with temporary(spark):
        roots = _roots(given, signed, nodes, width, percent)
        if roots is None:
            return rows, named
        found = roots.join(nodes, roots.node == nodes.sig, "right").select("sig", "copies", "rep", F.coalesce("root", "sig").alias("root"))
        found.write.parquet(path)
    return rows, spark.read.schema(named.schema).parquet(path)


def _roots(given: DataFrame, signed: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, root) of the nodes that have links, or nothing if none can."""
    spark = given.sparkSession
    n_nodes, total, of_rows = (int(x or 0) for x in nodes.agg(F.count("*"), F.sum("n"), F.sum(F.expr("n * copies"))).first())
    if n_nodes < 2:
        return None
    hot = spark.sparkContext.broadcast(_hot_shingles(signed, n_nodes, of_rows))
    # groups, and the tasks that they are dealt to, are as many as the data asks for, so that none grows with it
    n_groups = max(LEAST_GROUPS, total // PER_COUNT)
    n_tasks = n_groups // GROUPS
    back = _dealt(given, width, n_groups, hot).repartition(n_tasks, "part").groupBy("part").applyInArrow(_counted(n_groups), "home bigint, nodes binary, many binary, tokens binary, classes binary")
    homes = nodes.select(F.pmod("node", F.lit(n_groups)).alias("at_home"), "node", "sig", "n").repartition(n_tasks, "at_home")
    kept = homes.groupBy("at_home").cogroup(back.repartition(n_tasks, "home").groupBy("home")).applyInArrow(_assembled(percent), "sig binary, n bigint, tokens binary, classes binary")
    kept = written(kept, "nodes")
    prefix, whole = _masses(kept, percent)
    if not whole.sum():
        return None
    n_frag = max(LEAST_FRAGMENTS, int(prefix.sum()) // PER_FRAGMENT)
    pivots, cuts = _quantiles(prefix, np.arange(1, n_frag) / n_frag), _quantiles(whole, np.arange(1, CUTS) / CUTS)
    found = written(_fragments(kept, percent, pivots).repartition(n_frag // GROUPS, "frag").groupBy("frag").applyInArrow(_paired(percent), PAIR_DDL), "pairs")
    pairs = cut(_candidates(found, percent))
    lists = found.filter("list is not null").select("list", "a", "na")
    if pairs.isEmpty() and lists.isEmpty():
        return None
    sets = _cut_sets(kept, cuts)
    n_links = max(12, int(whole.sum()) // PER_TASK, pairs.count() // 20_000)
    known = components(cut(_linked(pairs, sets, percent, n_links)))
    links = known.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not lists.isEmpty():
        links = links.unionByName(_long_list_links(lists, known, sets, percent))
    return components(links)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    A document's set holds the distinct ``width``-word shingles of its whole text, A-Z lowered; with fewer words all of
    them as one shingle. Documents link where 100 * intersection >= percent * union, and component_id is the
    smallest doc_id reachable by links, its own included. A null, empty or blank text has no set and links with
    nothing. Equal sets link; repeated rows each get a row. A null id counts above all others: it names a component
    only if no member has an id. Texts may have any length. Other columns are not looked at; an empty table gives an empty
    result.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows, named = _named_nodes(given, width, percent)
    told = _told(named).select("sig", "salt", F.col("least.doc_id").alias("component_id"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(told, ["sig", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _told(named: DataFrame) -> DataFrame:
    """(sig, least, salt) of nodes that have copies or links; the rows of one node are dealt to SALTS parts."""
    least = named.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("members"))
    return named.join(least, "root").filter("copies > 1 or members > 1").select("sig", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each group of near duplicates, as near_duplicates() finds them.

    Of a group the row with the smallest id stays, those without one last; of rows that share it, the one whose text has the
    least hash; of equal rows, one. Unlike texts stay, with a shared id or without any, and so do all rows without
    words. Columns are those of docs. An empty table gives an empty result.
    """
    at = {"__pl_id": F.col(id_col).cast("bigint"), "__pl_th": F.xxhash64(text_or_empty(text_col))}
    given = docs.select(at["__pl_id"].alias("doc_id"), at["__pl_th"].alias("th"), text_or_empty(text_col).alias("text"))
    rows, named = _named_nodes(given, width, percent)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")).join(_told(named), ["sig", "salt"])
    one = F.expr("least.doc_id <=> doc_id and least.th = th").alias("first")
    verdict = cut(rows.select("doc_id", "th", one).groupBy("doc_id", "th").agg(F.max("first").alias("first"), F.count("*").alias("rows")).filter("not first or rows > 1"))
    verdict = verdict.select(F.col("doc_id").alias("__pl_id"), F.col("th").alias("__pl_th"), F.col("first").alias("__pl_first"))
    keyed = docs.withColumns(at)
    same = (keyed["__pl_th"] == verdict["__pl_th"]) & keyed["__pl_id"].eqNullSafe(verdict["__pl_id"])
    joined = keyed.join(verdict.drop("__pl_first"), same, "left_anti")
    if verdict.filter("__pl_first").isEmpty():
        return joined.select(*docs.columns)
    again = keyed.join(verdict.filter("__pl_first"), same, "left_semi").dropDuplicates(["__pl_id", "__pl_th"])
    return joined.unionByName(again).select(*docs.columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x != '') as words from documents
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) end as shingles from w
), n as (select doc_id, len(shingles) as n_shingles from s),
t as (select doc_id, unnest(shingles) as sh from s),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as i from t a join t b on a.sh = b.sh and a.doc_id < b.doc_id group by all
), links as (
  select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 80 * (p.n_shingles + q.n_shingles - i)
), both_ways as (select x, y from links union all select y, x from links),
reach(x, y) as (select doc_id, doc_id from n union select r.x, b.y from reach r join both_ways b on r.y = b.x)
select n.doc_id, cast(n.n_shingles as bigint) as n_shingles, min(r.y) as component_id from n join reach r on r.x = n.doc_id group by 1, 2
"""
