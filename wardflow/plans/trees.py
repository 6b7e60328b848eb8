"""Decision trees, forests and boosting of Spark's kind, grown by numpy inside one task.

What spark.ml does level by level with a job for each, over rows that fit into a task: features cut
into at most 32 bins by the same borders, the same gains, the same leaves, the same pruning, and for
boosting the same residuals. A task holds one byte for each row and feature. The draws of a
forest (rows of a tree, features of a node) are other random numbers than Spark's.
"""

import time

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

BINS = 32
EPSILON = 2.0**-52
SAMPLE = max(BINS * BINS, 10_000)  # rows that the borders are taken from
CELLS = 1 << 20  # (node, feature, bin) counted at once


def borders(values, n, share=1.0):
    """Borders of the bins of one feature, from the sampled values of a share of n rows."""
    seen, counts = np.unique(values[values != 0], return_counts=True)
    counts, total = counts.astype(float), share * n
    if not len(seen):
        return np.zeros(0)
    if total - counts.sum() > EPSILON * total * 100:
        at = np.searchsorted(seen, 0.0)
        seen, counts = np.insert(seen, at, 0.0), np.insert(counts, at, total - counts.sum())
    middles, splits = (seen[:-1] + seen[1:]) / 2.0, min(BINS, n) - 1
    if len(middles) <= splits:
        return middles
    out, stride = [], total / (splits + 1)
    upto, target = np.cumsum(counts), stride
    for i, middle in enumerate(middles.tolist()):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(middle)
            target += stride
    return np.array(out)


def binned(values, cuts):
    """Bins of rows of values: a feature is left of border i where its bin is at most i."""
    return np.array([np.searchsorted(c, values[:, f], side="left") for f, c in enumerate(cuts)], np.uint8).reshape(len(cuts), len(values))


def gini(stats):
    """(rows, impurity) of sums of rows of each class."""
    n = stats[0].copy()
    for s in stats[1:]:
        n += s
    some = np.maximum(n, 1e-300)
    impurity = 1.0 - (stats[0] / some) ** 2
    for s in stats[1:]:
        impurity -= (s / some) ** 2
    return n, np.where(n == 0, 0.0, impurity)


def variance(stats):
    """(rows, impurity) of the sums of 1, x and x * x."""
    n, total, squares = stats
    some = np.maximum(n, 1.0)
    return n, np.where(n == 0, 0.0, (squares - total * total / some) / some)


class Tree:
    """Nodes in arrays; the root is node 0, children have higher numbers and stand side by side. A leaf has feature -1."""

    FIELDS = {"feature": np.int16, "border": np.uint8, "child": np.int32, "gain": np.float64, "impurity": np.float64}

    def __init__(self, stats, **fields):
        self.stats = stats  # one row of sums for each node
        self.__dict__.update({name: np.asarray(fields[name], kind) for name, kind in self.FIELDS.items()})

    def values(self, kind):
        """The prediction of each node: the commonest class, or the mean."""
        if kind is gini:
            return self.stats.argmax(1).astype(float)
        return np.where(self.stats[:, 0] == 0, 0.0, self.stats[:, 1] / np.maximum(self.stats[:, 0], 1.0))

    def leaves(self, bins):
        """Leaf of each row."""
        at, going = np.zeros(bins.shape[1], np.int32), np.arange(bins.shape[1])
        while len(going):
            node = at[going]
            feature = self.feature[node]
            inner = feature >= 0
            going, node, feature = going[inner], node[inner], feature[inner]
            at[going] = self.child[node] + (bins[feature, going] > self.border[node])
        return at

    def pruned(self, kind):
        """(tree without pairs of leaves that predict the same, its node for each node of this tree)."""
        said, leaf = self.values(kind), self.feature < 0
        up = np.full(len(leaf), -1)
        inner = np.flatnonzero(~leaf)
        up[self.child[inner]] = up[self.child[inner] + 1] = inner
        into = np.arange(len(leaf))
        check = inner[leaf[self.child[inner]] & leaf[self.child[inner] + 1]]
        while len(check):
            check = np.unique(check)
            left = self.child[check]
            same = check[leaf[left] & leaf[left + 1] & (said[left] == said[left + 1])]
            leaf[same] = True
            into[self.child[same]] = into[self.child[same] + 1] = same
            check = up[same]
            check = check[check >= 0]
        keep = np.ones(len(leaf), bool)
        keep[1:] = ~leaf[up[1:]]
        for _ in range(64):  # a node goes with its parent; parents have lower numbers
            gone = keep.copy()
            gone[1:] &= keep[up[1:]]
            if (gone == keep).all():
                break
            keep = gone
        while (into[into] != into).any():
            into = into[into]
        number = np.cumsum(keep) - 1
        fields = {name: getattr(self, name)[keep] for name in self.FIELDS}
        fields["feature"] = np.where(leaf[keep], -1, fields["feature"])
        fields["gain"] = np.where(leaf[keep], -1.0, fields["gain"])
        fields["child"] = np.where(leaf[keep], -1, number[np.maximum(fields["child"], 0)])
        return Tree(self.stats[keep], **fields), number[into]

    def importances(self, features, kind):
        """Gain times rows of the nodes of each feature, which make 1 together."""
        inner = self.feature >= 0
        weight = kind(list(self.stats.T))[0] * self.gain
        out = np.bincount(self.feature[inner], weight[inner], features)
        return out / out.sum() if out.sum() > 0 else out

    def packed(self):
        return {name: getattr(self, name).tobytes() for name in self.FIELDS} | {"stats": self.stats.tobytes()}

    @classmethod
    def unpacked(cls, row):
        fields = {name: np.frombuffer(row[name], kind) for name, kind in cls.FIELDS.items()}
        return cls(np.frombuffer(row["stats"], np.float64).reshape(len(fields["feature"]), -1), **fields)


def _best(hist, widths, impurity, kind, least):
    """(gain, index of the split, sums on its left and right, their impurities) of each node.

    hist: sums by (node, feature, bin); impurity: of the nodes; widths: borders of each of their features.
    """
    left = [h.cumsum(-1) for h in hist]
    total = [c[..., -1:] for c in left]
    left = [c[..., :-1] for c in left]
    right = [t - c for t, c in zip(total, left)]
    (n_left, i_left), (n_right, i_right) = kind(left), kind(right)
    n = np.maximum(n_left + n_right, 1e-300)
    gain = impurity[:, None, None] - n_left / n * i_left - n_right / n * i_right
    bad = (n_left < least) | (n_right < least) | (gain < 0) | (np.arange(gain.shape[-1]) >= widths[..., None])
    gain = np.where(bad, -np.inf, gain).reshape(len(gain), -1)
    at, rows = gain.argmax(1), np.arange(len(gain))

    def chosen(a):
        return a.reshape(len(gain), -1)[rows, at]

    return gain[rows, at], at, [chosen(a) for a in left], [chosen(a) for a in right], chosen(i_left), chosen(i_right)


def mixed(numbers):
    """Random 64-bit numbers that depend on the given ones only (splitmix64)."""
    x = np.asarray(numbers, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_of(seed, tree):
    """The number that all draws of a tree depend on."""
    return mixed(mixed([seed & (2**64 - 1)]) + np.uint64(tree))


#: Chances that a Poisson number of mean 1 is at most 0, 1, 2 and so on.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 20)]))


def drawn(ids, key):
    """How often a tree draws each row."""
    return np.searchsorted(POISSON, (mixed(np.asarray(ids, np.uint64) ^ key) >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def picks(keys, features, subset):
    """The features, in order, that nodes with these keys may be split by."""
    if subset >= features:
        return np.broadcast_to(np.arange(features), (len(keys), features))
    lots = mixed(keys[:, None] ^ mixed(np.arange(1, features + 1)))
    return np.sort(np.argpartition(lots, subset - 1)[:, :subset])


def children(keys):
    """Keys of the left and the right child of each node, side by side."""
    return np.stack([mixed(keys ^ np.uint64(1)), mixed(keys ^ np.uint64(2))], 1).ravel()


def grow(bins, widths, sums, rows, depth, least, kind, subset=None, key=None):
    """(tree, leaf of each row of `rows`, in a table by row): best splits, level by level.

    sums: arrays by row that add up to the sums of a node; widths: number of borders of each
    feature; subset: number of features drawn for each node, by the key of the root.
    """
    widths, features, height = np.asarray(widths), len(widths), max(2, max(widths, default=0) + 1)
    flat, length = bins.ravel(), bins.shape[1]
    total = [np.array([s[rows].sum()]) for s in sums]
    nodes = {"feature": [[-1]], "border": [[0]], "child": [[-1]], "gain": [[-1.0]], "impurity": [kind(total)[1]]}
    stats, count, where = [np.stack(total, 1)], 1, np.zeros(length, np.int32)
    ids, sizes, first = np.zeros(1, np.int64), np.array([len(rows)]), True
    rows, n_picked = np.asarray(rows), min(subset or features, features)
    keys = np.zeros(1, np.uint64) if key is None else np.asarray(key, np.uint64)
    at_once = max(1, CELLS // (n_picked * height))
    impurity = kind(total)[1]
    for level in range(depth):
        if not len(ids) or not widths.any():
            break
        begins = np.concatenate([[0], np.cumsum(sizes)])
        kept_rows, kept_ids, kept_sizes, kept_impurity, kept_keys, born = [], [], [], [], [], []
        for a in range(0, len(ids), at_once):
            b = min(a + at_once, len(ids))
            mine, size, k = rows[begins[a] : begins[b]], sizes[a:b], b - a
            slot = np.repeat(np.arange(k), size)
            picked = picks(keys[a:b], features, n_picked)
            hist = [np.empty((k, n_picked, height)) for _ in sums]
            weights = [s[mine] for s in sums]
            base = slot * height
            for j in range(n_picked):
                cell = bins[j][mine] if n_picked == features else flat[picked[:, j][slot] * length + mine]
                key = base + cell
                for h, w in zip(hist, weights):
                    h[:, j] = np.bincount(key, w, k * height).reshape(k, height)
            wide = widths[picked]
            if first:  # as Spark does: the root's sums are those of its first split's sides
                first, j = False, int((wide[0] > 0).argmax())
                total = [np.array([h[0, j, 0] + (h[0, j].cumsum()[-1] - h[0, j, 0])]) for h in hist]
                impurity = kind(total)[1]
                nodes["impurity"][0], stats[0] = impurity, np.stack(total, 1)
            gain, at, left, right, i_left, i_right = _best(hist, wide, impurity[a:b], kind, least)
            split = gain > 0
            feature, border = picked[np.arange(k), at // (height - 1)], at % (height - 1)
            # rows go to the sides and keep their order
            going = split[slot]
            mine, slot = mine[going], slot[going]
            order = np.cumsum(split) - 1
            slot, size, feature, border = order[slot], size[split], feature[split], border[split]
            k = len(size)
            if not k:
                continue
            to_left = flat[feature[slot] * length + mine] <= border[slot]
            n_left = np.bincount(slot[to_left], minlength=k)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            ranks = np.cumsum(to_left)
            before = np.concatenate([[0], np.cumsum(n_left)[:-1]])
            rank = ranks - before[slot]  # rows on the left up to this one
            place = np.where(to_left, begin[slot] + rank - 1, np.arange(len(mine)) + n_left[slot] - rank)
            sided = np.empty_like(mine)
            sided[place] = mine
            child = count + np.arange(2 * k)
            count += 2 * k
            sizes_2 = np.stack([n_left, size - n_left], 1).ravel()
            where[sided] = np.repeat(child, sizes_2)
            impure = np.stack([i_left[split], i_right[split]], 1).ravel()
            born.append((ids[a:b][split], feature, border, child[::2], gain[split]))
            nodes["impurity"].append(impure)
            stats.append(np.stack([np.stack([x[split], y[split]], 1).ravel() for x, y in zip(left, right)], 1))
            for name, value in (("feature", -1), ("border", 0), ("child", -1), ("gain", -1.0)):
                nodes[name].append(np.full(2 * k, value))
            alive = (np.abs(impure) >= EPSILON) & (level + 1 < depth)
            kept_rows.append(sided[np.repeat(alive, sizes_2)])
            kept_ids.append(child[alive])
            kept_sizes.append(sizes_2[alive])
            kept_impurity.append(impure[alive])
            kept_keys.append(children(keys[a:b][split])[alive])
        flat_nodes = {name: np.concatenate(nodes[name]) for name in ("feature", "border", "child", "gain")}
        for parent, feature, border, child, gain in born:
            flat_nodes["feature"][parent], flat_nodes["border"][parent] = feature, border
            flat_nodes["child"][parent], flat_nodes["gain"][parent] = child, gain
        nodes.update({name: [value] for name, value in flat_nodes.items()})
        if not kept_ids:
            break
        rows, ids, sizes, impurity, keys = (np.concatenate(x) for x in (kept_rows, kept_ids, kept_sizes, kept_impurity, kept_keys))
    return Tree(np.concatenate(stats), **{name: np.concatenate(x) for name, x in nodes.items()}), where


def in_order(bins, labels):
    """Order of the rows by their bins and label, so that draws do not depend on how the table was read."""
    content = np.concatenate([bins, labels[None].astype(np.uint8)])
    content = np.concatenate([content, np.zeros((-len(content) % 8, content.shape[1]), np.uint8)])
    words = [np.ascontiguousarray(content[i : i + 8].T).view(">u8").ravel() for i in range(0, len(content), 8)]
    return np.lexsort(words[::-1])


def forest_tree(bins, widths, labels, classes, seed, tree, depth, least, subset):
    """One tree of a forest over rows in order: Poisson counts of the rows, `subset` features drawn for each node; pruned."""
    key = key_of(seed, tree)
    counts = drawn(np.arange(len(labels)), key)
    sums = [np.where(labels == c, counts, 0.0) for c in range(classes)]
    return grow(bins, widths, sums, np.flatnonzero(counts), depth, least, gini, subset, key)[0].pruned(gini)[0]


def shares(tree):
    """Share of each class in each node."""
    return tree.stats / np.maximum(tree.stats.sum(1, keepdims=True), 1e-300)


def boosted(bins, widths, labels, rounds, rate, depth, least):
    """The trees of boosting for the logistic loss, one after another, with their weights."""
    label, rows = 2.0 * labels - 1.0, np.arange(len(labels))
    target, margin, weight, ones = label, np.zeros(len(labels)), 1.0, np.ones(len(labels))
    for _ in range(rounds):
        tree, leaf = grow(bins, widths, [ones, target, target * target], rows, depth, least, variance)
        yield tree.pruned(variance)[0], weight
        margin = margin + tree.values(variance)[leaf] * weight
        target = 4.0 * label / (1.0 + np.exp(2.0 * label * margin))
        weight = rate


# tasks --------------------------------------------------------------------------------


def gathered(batches, cuts):
    """(bins, labels, folds) of all rows of a task; folds are missing where there is no such column."""
    parts = []
    for batch in batches:
        values = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
        fold = batch["fold"].to_numpy(zero_copy_only=False) if "fold" in batch.schema.names else None
        parts.append((binned(values, cuts), batch["y"].to_numpy(zero_copy_only=False), fold))
    bins, labels, folds = zip(*parts) if parts else ([np.zeros((len(cuts), 0), np.uint8)], [np.zeros(0)], [None])
    return np.concatenate(bins, 1), np.concatenate(labels), None if folds[0] is None else np.concatenate(folds)


TREES = "tree int, nodes int, weight double, importances array<double>, stats binary, " + ", ".join(f"{f} binary" for f in Tree.FIELDS)


def _row(number, tree, weight, kind, features):
    importances = tree.importances(features, kind).tolist()
    return pa.RecordBatch.from_pylist([{"tree": number, "nodes": len(tree.feature), "weight": weight, "importances": importances, **tree.packed()}], _SCHEMA)


_SCHEMA = pa.schema(
    [("tree", pa.int32()), ("nodes", pa.int32()), ("weight", pa.float64()), ("importances", pa.list_(pa.float64())), ("stats", pa.binary())]
    + [(f, pa.binary()) for f in Tree.FIELDS]
)


def forest_rows(batches, numbers, cuts, **options):
    """The trees of these numbers as rows of the table TREES."""
    bins, labels, _ = gathered(batches, cuts)
    order = in_order(bins, labels)
    bins, labels = np.ascontiguousarray(bins[:, order]), labels[order]
    for i in numbers:
        yield _row(i, forest_tree(bins, [len(c) for c in cuts], labels, tree=i, **options), 1.0, gini, len(cuts))


def boosted_rows(batches, cuts, **options):
    """The trees of boosting as rows of the table TREES."""
    bins, labels, _ = gathered(batches, cuts)
    for i, (tree, weight) in enumerate(boosted(bins, [len(c) for c in cuts], labels, **options)):
        yield _row(i, tree, weight, variance, len(cuts))


VOTES = "setting int, label double, raw array<double>, seconds double"


def _votes(setting, labels, raw, seconds):
    for a in range(0, max(1, len(labels)), 50_000):
        part = raw[a : a + 50_000]
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * raw.shape[1])
        lists = pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))
        fixed = [pa.array(np.full(len(part), v, kind)) for v, kind in ((setting, np.int32), (seconds, np.float64))]
        yield pa.RecordBatch.from_arrays([fixed[0], pa.array(labels[a : a + 50_000]), lists, fixed[1]], ["setting", "label", "raw", "seconds"])


def _sides(batches, cuts, fold):
    bins, labels, folds = gathered(batches, cuts)
    held = folds == fold
    return [(np.ascontiguousarray(bins[:, side]), labels[side]) for side in (~held, held)]


def forest_votes(batches, cuts, fold, setting, n_trees, classes, **options):
    """A forest of the rows outside the fold votes on the rows inside it."""
    (bins, labels), (held, wanted) = _sides(batches, cuts, fold)
    order, start = in_order(bins, labels), time.time()
    bins, labels, raw = np.ascontiguousarray(bins[:, order]), labels[order], np.zeros((len(wanted), classes))
    spent = time.time() - start
    for i in range(n_trees):
        start = time.time()
        tree = forest_tree(bins, [len(c) for c in cuts], labels, classes, tree=i, **options)
        spent += time.time() - start
        raw += shares(tree)[tree.leaves(held)]
    yield from _votes(setting, wanted, raw, spent)


def tree_votes(batches, cuts, fold, setting, classes, **options):
    """A single tree of the rows outside the fold votes on the rows inside it."""
    (bins, labels), (held, wanted) = _sides(batches, cuts, fold)
    start, sums = time.time(), [(labels == c).astype(np.float64) for c in range(classes)]
    tree, _ = grow(bins, [len(c) for c in cuts], sums, np.arange(len(labels)), kind=gini, **options)
    tree, spent = tree.pruned(gini)[0], time.time() - start
    yield from _votes(setting, wanted, shares(tree)[tree.leaves(held)], spent)


def boosted_votes(batches, cuts, fold, marks, **options):
    """Boosting of the rows outside the fold votes on those inside it, after as many rounds as each (setting, rounds) of marks says."""
    (bins, labels), (held, wanted) = _sides(batches, cuts, fold)
    margin, start, spent, found = np.zeros(len(wanted)), time.time(), 0.0, []
    fitting = boosted(bins, [len(c) for c in cuts], labels, max(rounds for _, rounds in marks), **options)
    for i, (tree, weight) in enumerate(fitting, 1):
        spent += time.time() - start
        margin = margin + tree.values(variance)[tree.leaves(held)] * weight
        found += [(setting, margin) for setting, rounds in marks if rounds == i]
        start = time.time()
    for setting, at in found:
        yield from _votes(setting, wanted, np.stack([-at, at], 1), spent)


NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def _lists(values, sizes):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def spark_nodes(batches, cuts, kind):
    """Rows of TREES as the rows in which Spark saves the nodes of its trees."""
    table = np.full((len(cuts), BINS), np.nan)
    for f, cut in enumerate(cuts):
        table[f, : len(cut)] = cut
    for batch in batches:
        for row in batch.to_pylist():
            tree = Tree.unpacked(row)
            n, inner = len(tree.feature), tree.feature >= 0
            thresholds = _lists(table[tree.feature[inner], tree.border[inner]], inner.astype(np.int64))
            split = pa.StructArray.from_arrays(
                [pa.array(tree.feature.astype(np.int32)), thresholds, pa.array(np.full(n, -1, np.int32))],
                ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
            )
            columns = {
                "id": np.arange(n, dtype=np.int32), "prediction": tree.values(kind), "impurity": tree.impurity,
                "impurityStats": _lists(tree.stats.ravel(), np.full(n, tree.stats.shape[1])), "rawCount": kind(list(tree.stats.T))[0].astype(np.int64),
                "gain": tree.gain, "leftChild": tree.child, "rightChild": np.where(inner, tree.child + 1, -1).astype(np.int32), "split": split,
            }
            data = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["tree"], np.int32)), data], ["treeID", "nodeData"])


def packed_rows(batches, cuts, parts):
    """Numbers and bins of rows, a block of them in a row."""
    for i, batch in enumerate(batches):
        values = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
        row = {"part": (31 * TaskContext.get().partitionId() + i) % parts, "ids": batch["id"].to_numpy().tobytes(), "bins": binned(values, cuts).tobytes()}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("bins", pa.binary())]))


PART = "part int, some int, ids binary, votes binary"
_PART = pa.schema([("part", pa.int32()), ("some", pa.int32()), ("ids", pa.binary()), ("votes", pa.binary())])


def part_votes(key, blocks, trees, features, classes):
    """Votes of some trees on a part of the rows, in the order of the rows' numbers."""
    blocks = blocks.to_pylist()
    ids = np.concatenate([np.frombuffer(b["ids"], np.int64) for b in blocks] or [np.zeros(0, np.int64)])
    if not len(ids):
        return _PART.empty_table()
    order = np.argsort(ids)
    bins = np.ascontiguousarray(np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(features, -1) for b in blocks], 1)[:, order])
    votes = np.zeros((len(ids), classes))
    numbers = trees["tree"].to_numpy()
    for i in np.argsort(numbers):
        tree = Tree.unpacked(trees.slice(i, 1).to_pylist()[0])
        votes += shares(tree)[tree.leaves(bins)]
    row = {"part": key[0].as_py(), "some": key[1].as_py(), "ids": ids[order].tobytes(), "votes": votes.tobytes()}
    return pa.Table.from_pylist([row], _PART)


def all_votes(table, classes, number):
    """Sums of the votes of all trees on a part of the rows, a row for each."""
    ids, votes = None, 0.0
    for i in np.argsort(table["some"].to_numpy()):  # always in this order: sums of doubles depend on it
        row = table.slice(i, 1).to_pylist()[0]
        ids, votes = np.frombuffer(row["ids"], np.int64), votes + np.frombuffer(row["votes"]).reshape(-1, classes)
    return pa.table({number: ids, "votes": _lists(votes.ravel(), np.full(len(ids), classes))})
