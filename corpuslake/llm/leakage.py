"""Evaluation items leaking into documents (problem 8), by latent semantic retrieval.

Documents are parsed once: words become 64-bit hashes, and the sequences are written to the
checkpoint folder. A document is divided into blocks of ``run`` words; every two
neighbouring blocks are a passage, so any ``run`` consecutive words lie whole in one.
Passages have TF-IDF weights over hashed word slots. A randomised SVD over all passages
gives the latent space: the corpus times a Gaussian sketch is summed in every partition
and then over partitions.

Items are searched by the windows of ``run`` words at every place. An inverted index on the
rarest words of each window says which passages a window may lie in at all. Of these pairs
the latent space drops those whose cosine rules the window out, by a bound that holds for
any data: a passage that contains a window has at least the cosine ``|window| / |passage|``
with it (lengths before normalising), and the true cosine is at most the latent product
plus the product of what the latent space leaves of both. What is left is checked word by
word, and the longest shared run is measured.

Paraphrases are found by the latent cosine of a passage with a passage of the item, then
by the longest common subsequence with the item and by its answers, the rarest third of
its words, of which a quarter must stand in the passage and half near it.

Words are the longest runs of Unicode letters and digits, in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

WIDTH, RANK, EXTRA, RUN = 1 << 15, 56, 8, 12
#: Items are searched in blocks whose index stays below this, so what is sent to the tasks is bounded whatever the number of items.
MOST_INDEX_BYTES = 64 << 20
#: A window is looked up by its rarest word, and so many of its rarest words must stand in a passage.
RAREST = 4
PARAPHRASE_COSINE, PARAPHRASE_SHARE = 0.5, 0.7
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """Word to its 64-bit hash; bounded, since a corpus has any number of words."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[word] = h
        return h


def hashed(text: str | None, known: _Hashes) -> np.ndarray:
    found = words_of(text)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


class Blocks:
    """The words of some texts, in blocks of ``run`` words; passage i is block i and, within the same text, block i + 1."""

    def __init__(self, texts: list[np.ndarray], run: int):
        sizes = np.array([len(x) for x in texts], np.int64)
        self.run, self.texts = run, texts
        self.words = words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        self.slots = (words & np.uint64(WIDTH - 1)).astype(np.int64)
        per = -(-sizes // run)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(per)])  # the first block of each text
        self.n = int(self.first[-1])
        text = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.block = self.first[text] + at // run
        self.starts = np.searchsorted(self.block, np.arange(self.n))
        self.text = np.repeat(np.arange(len(texts)), per)
        last = np.zeros(self.n, bool)
        last[self.first[1:][per > 0] - 1] = True
        alone = np.zeros(self.n, bool)
        alone[self.first[:-1][per == 1]] = True
        self.pair = ~last  # whether a passage has a second block
        self.passages = np.flatnonzero(~last | alone)

    def keys(self, passages: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sorted passage * WIDTH + slot, how often) for some passages, or all."""
        own = np.zeros(self.n, bool)
        own[self.passages if passages is None else passages] = True
        before = np.zeros(self.n, bool)
        before[1:] = own[:-1] & self.pair[:-1]
        mine, next_ = own[self.block], before[self.block]
        keys = np.concatenate([self.block[mine] * WIDTH + self.slots[mine], (self.block[next_] - 1) * WIDTH + self.slots[next_]])
        keys.sort()
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[at], np.diff(at, append=len(keys))

    def lengths(self, idf: np.ndarray, passages: np.ndarray | None = None) -> np.ndarray:
        """The length of each passage's TF-IDF vector; 0 for blocks that begin none."""
        keys, n = self.keys(passages)
        return np.sqrt(np.bincount(keys // WIDTH, (n * idf[keys % WIDTH]) ** 2, self.n))

    def project(self, weighted: np.ndarray) -> np.ndarray:
        """Sums over the words of all blocks of their rows in ``weighted``, a basis times idf; a passage is the sum of its blocks."""
        out = np.zeros((self.n, weighted.shape[1]), np.float32)
        for a in range(0, self.n, 8192):
            lo, hi = self.starts[a], self.starts[a + 8192] if a + 8192 < self.n else len(self.slots)
            s = self.slots[lo:hi]
            out[a : a + 8192] = np.add.reduceat(weighted[s], self.starts[a : a + 8192] - lo, axis=0)
        return out

    def passage_sums(self, blocks: np.ndarray) -> np.ndarray:
        out = blocks.copy()
        out[:-1][self.pair[:-1]] += blocks[1:][self.pair[:-1]]
        return out


def _sequences(b: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in b["words"]]


def _lots(b: pd.DataFrame, most: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """A batch in lots of about ``most`` bytes of words; a longer document is a lot of its own."""
    lot = np.cumsum(b["words"].map(len).to_numpy(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(b)]
    for x, y in zip(edges, edges[1:], strict=False):
        if y > x:
            yield b.iloc[x:y]


def parsed(docs: DataFrame, key: str) -> DataFrame:
    """(key, words): the words of every text with a key as 64-bit hashes; null and empty texts have none and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for b in batches:
            words = [hashed(t, known).tobytes() for t in b["text"]]
            some = np.array([len(w) > 0 for w in words], bool)
            yield pd.DataFrame({key: b[key][some], "words": [w for w in words if w]})

    rows = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("bigint").alias(key), "text")
    return rows.mapInPandas(run, f"{key} bigint, words binary")


def _idf(docs: DataFrame, run: int) -> np.ndarray:
    """Inverse passage frequency of every slot, over all passages; as many rows reach the driver as there are slots."""

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(WIDTH, np.int64), 0
        for b in batches:
            for lot in _lots(b):
                blocks = Blocks(_sequences(lot), run)
                df += np.bincount(blocks.keys()[0] % WIDTH, minlength=WIDTH)
                n += len(blocks.passages)
        yield pd.DataFrame({"slot": np.append(np.flatnonzero(df), WIDTH), "n": np.append(df[df > 0], n)})

    counts = docs.select("words").mapInPandas(run_, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(WIDTH + 1)
    df[counts["slot"]] = counts["n"]
    return (np.log((1 + df[WIDTH]) / (1 + df[:WIDTH])) + 0.3).astype(np.float32)


def _latent(docs: DataFrame, idf: np.ndarray, run: int, rank: int, seed: int = 8) -> np.ndarray:
    """WIDTH x rank orthonormal basis of the latent space: a randomised range finder on A'A over all passages, then its eigenvectors (Nystrom).

    Every partition sums its share of A'(A * sketch) and sends it in blocks of slots; the
    sums over partitions are made per block, so no task and no driver holds the corpus.
    """
    wide = rank + EXTRA
    sketch = np.random.default_rng(seed).standard_normal((WIDTH, wide)).astype(np.float32)
    part = WIDTH // 64

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weighted = np.zeros((WIDTH, wide), np.float32), sketch * idf[:, None]
        for b in batches:
            for lot in _lots(b):
                blocks = Blocks(_sequences(lot), run)
                if not blocks.n:
                    continue
                length = blocks.lengths(idf)
                y = blocks.passage_sums(blocks.project(weighted)) / np.maximum(length, 1e-6)[:, None] ** 2
                y[length == 0] = 0
                # A word counts in the passage that its block begins and in the one that it ends.
                both = y.copy()
                both[1:][blocks.pair[:-1]] += y[:-1][blocks.pair[:-1]]
                order = np.argsort(blocks.slots, kind="stable")
                s = blocks.slots[order]
                for c in range(0, len(order), 65_536):
                    piece, own = s[c : c + 65_536], blocks.block[order[c : c + 65_536]]
                    starts = np.flatnonzero(np.diff(piece, prepend=-1))
                    total[piece[starts]] += np.add.reduceat(both[own], starts, axis=0) * idf[piece[starts], None]
        used = [i for i in range(0, WIDTH, part) if total[i : i + part].any()]
        yield pd.DataFrame({"block": used, "part": [total[i : i + part].tobytes() for i in used]}).astype({"block": "int64", "part": "object"})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((part, wide), np.float64)
        for x in b["part"]:
            total += np.frombuffer(x, np.float32).reshape(part, -1)
        return pd.DataFrame({"block": b["block"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    parts = docs.select("words").mapInPandas(run_, "block bigint, part binary")
    # With many partitions, partial sums in a step between keep any one task from holding more than a few of them.
    if docs.rdd.getNumPartitions() > 64:
        parts = parts.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("block", "lot").applyInPandas(lambda b: add(b[["block", "part"]]), "block bigint, part binary")
    sums = parts.groupBy("block").applyInPandas(add, "block bigint, part binary").toPandas()
    b = np.zeros((WIDTH, wide))
    for at, x in zip(sums["block"], sums["part"], strict=True):
        b[at : at + part] = np.frombuffer(x, np.float32).reshape(part, -1)
    inner = sketch.T.astype(np.float64) @ b
    val, vec = np.linalg.eigh((inner + inner.T) / 2)
    ok = val > max(val.max(), 0) * 1e-9
    out = np.zeros((WIDTH, rank), np.float32)
    if ok.any():
        u = np.linalg.svd(b @ (vec[:, ok] / np.sqrt(val[ok])), full_matrices=False)[0]
        out[:, : min(rank, u.shape[1])] = u[:, :rank]
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by whole-number bit operations (one bit for every place of ``a``)."""
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        if hit := places.get(w, 0) & row:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def longest_shared(item, doc) -> int:
    """The most consecutive words of an item that stand consecutively in a document."""
    places: dict = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    best, ends = 0, {}
    for w in doc:
        ends = {j: ends.get(j - 1, 0) + 1 for j in places.get(w, ())}
        if ends:
            best = max(best, *ends.values())
    return best


class Index:
    """What the tasks need of some items: their windows and passages with latent coordinates, and posting lists by slot."""

    def __init__(self, ids: list[int], items: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, run: int):
        self.ids, self.items, self.run, self.idf, self.weighted = ids, items, run, idf, basis * idf[:, None]
        spans, heads, owner = [], [], []
        window_words = []
        self.answers: list[frozenset] = []
        for i, w in enumerate(items):
            slots = (w & np.uint64(WIDTH - 1)).astype(np.int64)
            for a in range(max(1, len(w) - run + 1)):
                own = slots[a : a + run]
                spans.append(own)
                heads.append(np.resize(own[np.argsort(-idf[own], kind="stable")], RAREST) if len(own) < RAREST else own[np.argsort(-idf[own], kind="stable")[:RAREST]])
                window_words.append(np.resize(w[a : a + run], run))
                owner.append(i)
            distinct = np.unique(w)
            rare = np.argsort(-idf[(distinct & np.uint64(WIDTH - 1)).astype(np.int64)], kind="stable")
            self.answers.append(frozenset(distinct[rare[: -(-len(distinct) // 3)]].tolist()))
        self.window_item = np.array(owner, np.int64)
        lat, size = self._vectors(spans)
        # Coordinates of unit vectors, what the space leaves of them, and the length before.
        self.window, self.window_size = lat / size[:, None], size
        self.window_rest = np.sqrt(np.maximum(0, 1 - (self.window**2).sum(axis=1)))
        self.heads = np.array(heads, np.int64).reshape(-1, RAREST)
        self.window_of = _postings(self.heads[:, 0], np.arange(len(heads)))
        self.window_words = np.array(window_words, np.uint64).reshape(-1, run)
        self.window_words_n = np.array([len(x) for x in spans], np.int64)
        parts, owner, slot, at, least = [], [], [], [], []
        for i, w in enumerate(items):
            slots = (w & np.uint64(WIDTH - 1)).astype(np.int64)
            keys = np.unique((np.array(sorted(self.answers[i]), np.uint64) & np.uint64(WIDTH - 1)).astype(np.int64))
            for a in range(0, max(1, len(w) - run), run):
                slot += keys.tolist()
                least.append(-(-len(keys) // 4))
                at += [len(parts)] * len(keys)
                parts.append(slots[a : a + 2 * run])
                owner.append(i)
        self.part_item, self.part_least = np.array(owner, np.int64), np.array(least, np.int64)
        lat = self._vectors(parts)[0]
        self.part = lat / np.maximum(np.linalg.norm(lat, axis=1, keepdims=True), 1e-9)
        self.part_of = _postings(np.array(slot, np.int64), np.array(at, np.int64))

    def _vectors(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lat, size = np.zeros((len(rows), self.weighted.shape[1]), np.float32), np.zeros(len(rows), np.float32)
        for i, s in enumerate(rows):
            own, n = np.unique(s, return_counts=True)
            lat[i], size[i] = n @ self.weighted[own], np.sqrt(((n * self.idf[own]) ** 2).sum())
        return lat, np.maximum(size, 1e-6)


def _postings(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends by slot, values in order of slot)."""
    order = np.argsort(slots, kind="stable")
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(slots, minlength=WIDTH))]), values[order]


def _met(keys: np.ndarray, postings: tuple[np.ndarray, np.ndarray], least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passage, value): each value of a posting list with each passage that holds a slot of it, or at least ``least[value]`` of its slots.

    ``keys`` are distinct passage * WIDTH + slot.
    """
    ends, values = postings
    slot = keys % WIDTH
    n = ends[slot + 1] - ends[slot]
    hit = np.flatnonzero(n)
    size = n[hit]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    value = values[np.repeat(ends[slot[hit]], size) + inside]
    wide = max(1, int(values.max(initial=0)) + 1)
    met = np.repeat(keys[hit] // WIDTH, size) * wide + value
    if least is not None:
        met, count = np.unique(met, return_counts=True)
        met = met[count >= least[met % wide]]
    return met // wide, met % wide


def _stands(blocks: Blocks, at: np.ndarray, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a window's words (``n`` of each row) stand one after the other in its passage."""
    run = blocks.run
    end = np.concatenate([np.cumsum([len(x) for x in blocks.texts]), np.zeros(1, np.int64)])[blocks.text[at]]
    out = np.zeros(len(at), bool)
    for shift in range(run + 1):
        begin = blocks.starts[at] + shift
        same = begin + n <= end
        for k in range(run):
            some = np.flatnonzero(same & (n > k))
            same[some] = blocks.words[begin[some] + k] == words[some, k]
        out |= same
    return out


def _search(index: Index, keys: list[int], texts: list[np.ndarray], cosine: float, share: float) -> list[tuple]:
    """(doc_id, item_id, longest_run, similarity, kind) of some documents."""
    blocks = Blocks(texts, index.run)
    run = index.run
    held = blocks.keys()[0]
    at, window = _met(held, index.window_of)
    for head in range(1, RAREST):
        key = at * WIDTH + index.heads[window, head]
        found = np.minimum(np.searchsorted(held, key), len(held) - 1)
        at, window = at[held[found] == key], window[held[found] == key]
    near, part = _met(held, index.part_of, index.part_least)
    asked = np.unique(np.concatenate([at, near]))
    if not len(asked):
        return []
    length = blocks.lengths(index.idf, asked)
    # Coordinates of the asked passages alone: their words are taken from the blocks.
    use = np.zeros(blocks.n, bool)
    use[asked] = True
    use[1:] |= use[:-1] & blocks.pair[:-1]
    some = np.flatnonzero(use)
    place = np.full(blocks.n, -1)
    place[some] = np.arange(len(some))
    words = use[blocks.block]
    slots, own = blocks.slots[words], place[blocks.block[words]]
    sums = np.zeros((len(some), index.weighted.shape[1]), np.float32)
    starts = np.searchsorted(own, np.arange(len(some)))
    for a in range(0, len(some), 8192):
        lo, hi = starts[a], starts[a + 8192] if a + 8192 < len(some) else len(slots)
        sums[a : a + 8192] = np.add.reduceat(index.weighted[slots[lo:hi]], starts[a : a + 8192] - lo, axis=0)
    lat = sums[place[asked]]
    second = blocks.pair[asked]
    lat[second] += sums[place[asked[second] + 1]]
    lat /= np.maximum(length[asked], 1e-6)[:, None]
    row = np.searchsorted(asked, at)
    product = np.einsum("ij,ij->i", lat[row], index.window[window])
    rest = np.sqrt(np.maximum(0, 1 - (lat**2).sum(axis=1)))
    # The bound: a pair is left out only if the passage can't contain the window.
    able = product + rest[row] * index.window_rest[window] >= index.window_size[window] / np.maximum(length[at], 1e-6) - 1e-3
    norm = np.linalg.norm(lat, axis=1)
    at, window, row, product = at[able], window[able], row[able], product[able]
    value = product / np.maximum(norm[row] * np.linalg.norm(index.window[window], axis=1), 1e-9)
    stands = _stands(blocks, at, index.window_words[window], index.window_words_n[window])
    best: dict[tuple[int, int], float] = {}
    pairs = zip(blocks.text[at[stands]].tolist(), index.window_item[window[stands]].tolist(), strict=True)
    for pair, v in zip(pairs, value[stands].tolist(), strict=True):
        best[pair] = max(best.get(pair, -1.0), v)
    out = [(keys[i], index.ids[j], longest_shared(index.items[j].tolist(), texts[i].tolist()), min(1.0, v), "verbatim") for (i, j), v in best.items()]
    row = np.searchsorted(asked, near)
    value = np.einsum("ij,ij->i", lat[row], index.part[part]) / np.maximum(norm[row], 1e-9)
    looser: dict[tuple[int, int], float] = {}
    for k in np.flatnonzero(value >= cosine)[np.argsort(-value[value >= cosine], kind="stable")].tolist():
        i, j = int(blocks.text[near[k]]), int(index.part_item[part[k]])
        if (i, j) in best or (i, j) in looser or len(index.items[j]) < run // 2:
            continue
        words = index.items[j]
        start = (int(near[k]) - int(blocks.first[i])) * run
        wide = texts[i][max(0, start - len(words)) : start + 2 * run + len(words)]
        answers = index.answers[j]
        if 2 * len(answers & set(wide.tolist())) >= len(answers) and common_subsequence(words, wide) >= share * len(words):
            looser[i, j] = float(value[k])
    return out + [(keys[i], index.ids[j], 0, v, "paraphrase") for (i, j), v in looser.items()]


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, rank: int = RANK, cosine: float = PARAPHRASE_COSINE, paraphrase: float = PARAPHRASE_SHARE, most_index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, longest_run, similarity, kind): documents with wording of an item.

    longest_run is the longest run of words that a verbatim pair shares, 0 for a paraphrase.
    kind is ``verbatim`` (at least ``run`` consecutive words of the item stand in the
    document) or ``paraphrase`` (the longest common subsequence of words covers at least
    ``paraphrase`` of the item and at least half of the item's rare words, its answers,
    occur around the passage). Items with fewer words than ``run`` are matched as a whole.
    Null keys, null texts and texts without words match nothing; repeated items and documents are matched by their own keys.
    Words are compared by their 64-bit hashes. The items are searched in as many blocks as
    ``most_index_bytes`` asks for, each in one pass over the parsed documents.
    """
    rows = cut_lineage(parsed(docs, "doc_id"))
    idf = _idf(rows, run)
    basis = _latent(rows, idf, run, rank)
    asked = cut_lineage(parsed(items, "item_id"))
    # A word of an item costs at most a window and its share of a passage, with their coordinates.
    size = asked.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8 * (rank * 8 + 256)
    blocks = max(1, -(-size // most_index_bytes))
    found = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toPandas()
        if len(part):
            index = Index(part["item_id"].tolist(), _sequences(part), idf, basis, run)
            hits = rows.mapInPandas(_searcher(rows.sparkSession.sparkContext.broadcast(index), cosine, paraphrase), "doc_id bigint, item_id bigint, longest_run int, similarity double, kind string")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return rows.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("longest_run"), F.lit(0.0).alias("similarity"), F.lit("").alias("kind")).where("false")
    best = F.max_by(F.struct("longest_run", "similarity", "kind"), F.struct("longest_run", "similarity"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def _searcher(shared, cosine: float, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _lots(b):
                yield pd.DataFrame(_search(shared.value, part["doc_id"].tolist(), _sequences(part), cosine, share), columns=["doc_id", "item_id", "longest_run", "similarity", "kind"])

    return run


def contaminated(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, benchmark, documents): every leaked item with the number of documents that hold it verbatim."""
    by = found.where("kind = 'verbatim'").groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))
    return items.select("item_id", "benchmark").join(by, "item_id")
