"""Language-model scoring with a hierarchical Pitman-Yor process.

Each context (the word before, or the start of the text) is a restaurant of its own; all share one parent, the restaurant of single
words, whose base is uniform over the training words and one unknown word. A Gibbs sweep seats every context's customers anew, dish by
dish, given the parent's predictive probabilities and the restaurant's number of tables from the sweep before, then seats
the parent's (one for each table below). Counts are sharded by word, so a word's seating in all contexts and in the parent
lies in one row group; a sweep exchanges only the restaurants' totals. Those of CONTEXTS frequent words (owners, one a slot, found
in a few packs) and the parent's pass through the driver as vectors of fixed length. Any other context is told by 56 bits of
its word's hash; its customers are as many as the word has in the training texts, which the word's shard knows. Only pairs
seen twice or more have fewer tables than customers: shards send this difference to the word's shard, and get the tables back.
Which words are owners changes costs, not the model. A pack sends its distinct pairs of word and context once, counted in its
training texts; the shard keeps where each stands among its own, and answers with what they and their words hold. Sweeps are replayed from their totals and seeds rather than stored. Scores average the
predictive probabilities of the kept sweeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.common import cut, give_back
from corvex.llm.packs import build_packs, bundles, by_shard, runs, shard_count, squeeze, texts_of, unsqueeze
from corvex.llm.vec import U, Words, mix

CONTEXTS, END = 1 << 16, 0x5E11D0FD0C0DE
START, OTHER, DOCS_PER_SHARD, OWNER_PACKS = CONTEXTS - 2, CONTEXTS - 1, 1024, 8
WHOLE = U(1 << 56)  # marks a place that is a word's own, not an owner's slot
BURN_IN, KEPT, STRENGTH, PARENT_STRENGTH, EXACT = 1, 3, 1.0, 1.0, 48


def learns(doc_id: int | None) -> bool:
    """Training documents: crc32 of the id as text is no multiple of ten. A row without an id is held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def _walk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, hash of the word before, or 0) of every token of texts, each text's end included."""
    words = Words(texts)
    n = len(texts)
    at = np.arange(len(words.hashes)) + words.doc
    total = len(words.hashes) + n
    doc, word, before = np.empty(total, np.int64), np.full(total, U(END)), np.zeros(total, U)
    ends = words.offsets[:-1] + words.counts + np.arange(n)
    doc[at], doc[ends], word[at] = words.doc, np.arange(n), words.hashes
    before[at + 1] = words.hashes  # of what follows each word
    return doc, word, before


def _slots(words: np.ndarray) -> np.ndarray:
    return (mix(words) % U(START)).astype(np.int64)


def _idents(words: np.ndarray) -> np.ndarray:
    return mix(words) >> U(8)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, slot of the word before) of every token of texts, each text's end included."""
    doc, word, before = _walk(texts)
    return doc, word, np.where(before == 0, START, _slots(before))


def places(before: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The context of each token: the slot of an owner or the start, or else WHOLE and the word's ident."""
    slot = _slots(before)
    return np.where(before == 0, U(START), np.where(owner[slot] == before, slot.astype(U), WHOLE | _idents(before)))


def _fold(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bytes a place, and the idents of the others in order."""
    other = place >= WHOLE
    return np.where(other, U(OTHER), place).astype(np.uint16), place[other] ^ WHOLE


def _unfold(code: np.ndarray, rest: np.ndarray) -> np.ndarray:
    place = code.astype(U)
    place[code == OTHER] = rest | WHOLE
    return place


def distinct_pairs(texts: list[bytes], owner: np.ndarray, learned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts in order, how many contexts each has, these in order, and how often each pair is in the learned texts (all, if not given)."""
    learned = np.ones(len(texts), bool) if learned is None else learned
    got = [(word, places(before, owner), learned[at + doc]) for at, (doc, word, before) in ((at, _walk(part)) for at, part in runs(texts))]
    word, place, n = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool))
    order, new = _order(word, place)
    n = np.add.reduceat(n[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    word, place = word[order[new]], place[order[new]]
    first = _firsts(word)
    return word[first], np.diff(np.append(first, len(word))), place, n


def find_owners(packs: DataFrame) -> np.ndarray:
    """For each slot the hash of its most frequent word in about OWNER_PACKS packs, or 0."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                word, n = np.unique(np.concatenate([np.zeros(0, U), *(Words(part).hashes for _, part in runs(texts_of(blob)))]), return_counts=True)
                slot = _slots(word)
                order = np.lexsort((word, -n, slot))
                best = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]
                yield pa.RecordBatch.from_arrays([pa.array(slot[best]), pa.array(word[best].view(np.int64)), pa.array(n[best])], ["slot", "word", "n"])
        give_back()

    step = max(1, packs.count() // OWNER_PACKS)
    sums = packs.where(F.pmod(F.xxhash64("pack"), F.lit(step)) == 0).select("blob").mapInArrow(most, "slot long, word long, n long").groupBy("slot", "word").agg(F.sum("n").alias("n"))
    owner = np.zeros(CONTEXTS, U)
    for r in sums.groupBy("slot").agg(F.max_by("word", F.struct("n", "word")).alias("word")).collect():
        owner[r["slot"]] = U(r["word"] % (1 << 64))
    return owner


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), for each i."""
    counts = counts.astype(np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where keys in order differ from the one before."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))


def _order(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by word, then context, and the places in it of the first of each pair."""
    order = np.lexsort((context, word))
    return order, _firsts(word[order], context[order])


def _gaps(word: np.ndarray) -> np.ndarray:
    """Words in order as differences, which are shorter."""
    return np.diff(word, prepend=U(0))


def count_shards(packs: DataFrame, shards: int, owner: np.ndarray) -> DataFrame:
    """shard, blob (distinct words of the training tokens, how many contexts each has, these and counts), lean (what sweeps need of it) and asks (which pairs each pack has)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, ids, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                word, spread, place, n = distinct_pairs(texts_of(blob), owner, np.array([learns(i) for i in ids], bool))
                first, rows = np.cumsum(spread) - spread, []
                for shard, at in by_shard(_idents(word), shards):
                    own = ranges(first[at], spread[at])
                    rows.append((shard, pack, squeeze(_gaps(word[at]), spread[at].astype(np.uint32), *_fold(place[own]), n[own].astype(np.uint32))))
                yield bundles(rows, "shard pack blob")
        give_back()

    def merge(table: pa.Table) -> pa.Table:
        parts = [(np.cumsum(gaps, dtype=U), spread, _unfold(code, rest), n) for gaps, spread, code, rest, n in map(unsqueeze, table.column("blob").to_pylist())]
        sizes = np.array([(len(word), len(n)) for word, _, _, n in parts])
        word, spread, place, n = (np.concatenate(x) for x in zip(*parts))
        del parts
        give_back()
        heads = np.cumsum(spread, dtype=np.int64) - spread
        word = np.repeat(word, spread)
        order, new = _order(word, place)
        at = np.empty(len(order), np.int64)
        at[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        word, place, n = word[order[new]], place[order[new]], np.add.reduceat(n[order].astype(np.int64), new)
        first = _firsts(word)
        of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
        short = lambda x: np.diff(x, prepend=0).astype(np.int32)
        asks = squeeze(table.column("pack").to_numpy(), *sizes.T, short(of_word[at[heads]]), short(at), np.add.reduceat(n, first) > 0, n > 0)
        word, place, n = word[n > 0], place[n > 0], n[n > 0]
        first = _firsts(word)
        blob = squeeze(_gaps(word[first]), np.diff(np.append(first, len(word))).astype(np.uint32), *_fold(place), n.astype(np.uint64))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()]), **{k: pa.array([v], pa.binary()) for k, v in (("blob", blob), ("lean", _lean(word, place, n)), ("asks", asks))}})

    bundled = packs.select("pack", "ids", "blob").mapInArrow(count, "shard long, pack long, blob binary")
    return cut(bundled.groupBy("shard").applyInArrow(merge, "shard long, blob binary, lean binary, asks binary"), "counts")


def asked_of(asks: bytes) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """Which asked words and pairs of a shard are in the training texts, and for each pack the numbers of its own among all asked."""
    packs, words, pairs, word_at, pair_at, known_words, known_pairs = unsqueeze(asks)
    split = lambda short, sizes: np.split(np.cumsum(short, dtype=np.int64), np.cumsum(sizes)[:-1])
    return known_words, known_pairs, zip(packs.tolist(), split(word_at, words), split(pair_at, pairs), strict=True)


def _lean(word: np.ndarray, place: np.ndarray, n: np.ndarray) -> bytes:
    """Words but for those seen once, with how often in all and in pairs seen once; the pairs seen more often; how many words were left out."""
    first = _firsts(word)
    sums = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    count, single, many = sums(n), sums(n == 1), sums(n > 1)
    held = count > 1
    return squeeze(word[first][held], count[held], single[held], many[held].astype(np.uint32), *_fold(place[n > 1]), n[n > 1], np.array([(~held).sum()]))


def seat(n: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after n customers of one dish each took a seat; a new table has weight `fresh`, the others n - discount * t.

    The first EXACT customers sit down one by one, later ones in blocks that grow by a quarter, at the block's mean rate.
    """
    t = np.minimum(n, 1).astype(np.int64)
    live, j = np.flatnonzero(n > 1), 1
    while len(live):
        step = 1 if j < EXACT else max(1, j // 4)
        take = np.minimum(step, n[live] - j)
        seated = j + (take - 1) / 2
        p = fresh[live] / (fresh[live] + np.maximum(seated - discount * t[live], 1e-9))
        t[live] += rng.random(len(live)) < p if step == 1 else rng.binomial(take, p)
        j += step
        live = live[n[live] > j]
    return t


class Sweeps:
    """One shard's pairs seen twice or more through the sweeps whose totals are known; a customer alone has a table of its own."""

    def __init__(self, shard: int, lean: bytes, world: dict, told=None):
        """told: gives for `asked` the tables of these contexts after each sweep but the last."""
        word, self.count, single, many, code, rest, n, (self.left_out,) = unsqueeze(lean)
        self.words, self.code, self.n = word, code.astype(np.int64), n
        of_word, place = np.repeat(np.arange(len(word)), many), _unfold(code, rest)
        other = np.flatnonzero(code == OTHER)
        own = np.flatnonzero(world["owner"][_slots(word)] != word)
        whole = WHOLE | _idents(word[own])
        self.asked = np.unique(np.concatenate([place[other], whole]))
        self.other, self.at, self.own, self.own_at = other, np.searchsorted(self.asked, place[other]), own, np.searchsorted(self.asked, whole)
        self.told = told(self.asked) if told else ()
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # tables of pairs, parent's customers and tables
        tables, parent = np.zeros(len(n)), np.full(len(word), 1.0 / (world["V"] + 1))
        for sweep in range(len(world["totals"]) + 1):
            rng = np.random.default_rng((shard, sweep))
            t = seat(n, (STRENGTH + world["d"] * tables) * parent[of_word], world["d"], rng)
            customers = single + np.bincount(of_word, t, len(word)).astype(np.int64)
            above = seat(customers, np.full(len(word), (PARENT_STRENGTH + world["d0"] * (world["totals"][sweep - 1][-1] if sweep else 0.0)) / (world["V"] + 1)), world["d0"], rng)
            self.kept.append((t, customers, above))
            if sweep < len(world["totals"]):
                totals = world["totals"][sweep]
                tables = totals[self.code]
                if len(other):
                    tables[other] = self.told[sweep][self.at]
                parent = parent_probability(customers, above, totals, world)

    def totals(self) -> np.ndarray:
        """How many fewer tables than customers each owner's context has, then the parent's customers and tables, after the last sweep."""
        t, customers, above = self.kept[-1]
        fewer = np.bincount(self.code, self.n - t, CONTEXTS)
        fewer[OTHER] = 0
        return np.concatenate([fewer, [customers.sum() + self.left_out, above.sum() + self.left_out]])

    def change(self) -> np.ndarray:
        """For the contexts in `asked` what this shard adds to their tables: its own words' customers, less what its pairs have fewer."""
        out = -np.bincount(self.at, (self.n - self.kept[-1][0])[self.other], len(self.asked))
        out[self.own_at] += self.count[self.own]
        return out.astype(np.int64)


class Seating:
    """One shard's words and pairs, all of them, through the sweeps whose totals are known."""

    def __init__(self, shard: int, blob: bytes, world: dict, told=None):
        gaps, spread, code, rest, n = unsqueeze(blob)
        self.pair_place, self.pair_context, self.pair_n = _unfold(code, rest), code.astype(np.int64), n.astype(np.int64)
        self.words, self.of_word = np.cumsum(gaps, dtype=U), np.repeat(np.arange(len(spread)), spread)
        self.count = np.bincount(self.of_word, self.pair_n, len(spread)).astype(np.int64)
        self.sweeps = Sweeps(shard, _lean(self.words[self.of_word], self.pair_place, self.pair_n), world, told)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # tables of pairs, parent's customers and tables
        many, held = self.pair_n > 1, self.count > 1
        for t, customers, above in self.sweeps.kept:
            every = np.ones(len(n), np.int64), np.ones(len(spread), np.int64), np.ones(len(spread), np.int64)
            every[0][many], every[1][held], every[2][held] = t, customers, above
            self.kept.append(every)


def parent_probability(customers, tables, totals: np.ndarray, world: dict):
    """Predictive probability of a dish in the parent; with no customers and tables, of a word never seen."""
    below, own = totals[-2], totals[-1]
    return (customers - world["d0"] * tables + (PARENT_STRENGTH + world["d0"] * own) / (world["V"] + 1)) / (PARENT_STRENGTH + below)


def _sums(df: DataFrame, make, size: int) -> np.ndarray:
    """The sum of a vector of fixed length over the rows of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += make(shard, blob)
        give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "x"])

    out = np.zeros(size)
    for r in df.select("shard", "blob").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def _world_counts(shard: int, blob: bytes) -> np.ndarray:
    """Customers of each owner's context, then V, N, pairs seen once and twice, words in one and in two contexts."""
    _, spread, code, _, n = unsqueeze(blob)
    customers = np.bincount(code, n.astype(float), CONTEXTS)
    customers[OTHER] = 0
    return np.concatenate([customers, [len(spread), n.sum(), (n == 1).sum(), (n == 2).sum(), (spread == 1).sum(), (spread == 2).sum()]])


def predictive(world: dict, context: np.ndarray, n: np.ndarray, tables: list[np.ndarray], parents: list[np.ndarray], held: tuple | None = None) -> np.ndarray:
    """The probability of a word after a context, averaged over the kept sweeps: n customers at tables[k] tables, parents[k] in the parent.

    held: customers and each kept sweep's tables of the whole contexts, where they are no owners'.
    """
    customers, whole = held or (world["C"][context], [total[context] for total in world["totals"][BURN_IN:]])
    out = np.zeros(len(n))
    for t, parent, total in zip(tables, parents, whole, strict=True):
        out += n - world["d"] * t + (STRENGTH + world["d"] * total) * parent
    return out / (STRENGTH + customers) / KEPT


def _told(rows: pa.Table, asked: np.ndarray, shards: int) -> tuple:
    """Each sweep's tables of the contexts in `asked`, from rows of sweep, home and blob."""
    parts = dict(by_shard(asked ^ WHOLE, shards))
    out: dict[int, np.ndarray] = {}
    for sweep, home, blob in zip(*(rows.column(c).to_pylist() for c in ("sweep", "home", "blob")), strict=True):
        out.setdefault(sweep, np.zeros(len(asked)))[parts[home]] = unsqueeze(blob)[0]
    return tuple(out[k] for k in sorted(out))


def fit(packs: DataFrame, shards: int) -> tuple[DataFrame, dict]:
    """The counts by shard, and the restaurants' totals through all sweeps (owners' as vectors, the others' as a table `told`: shard, sweep, home, blob)."""
    owner = find_owners(packs)
    counts = count_shards(packs, shards, owner)
    got = _sums(counts, _world_counts, CONTEXTS + 6)
    n1, n2, w1, w2 = got[CONTEXTS + 2 :]
    world = {"C": got[:CONTEXTS], "V": int(got[CONTEXTS]), "N": int(got[CONTEXTS + 1]), "d": min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2))), "d0": min(0.95, max(0.05, w1 / max(1, w1 + 2 * w2))), "totals": [], "owner": owner}
    told = None

    def swept(shard: int, sweeps: Sweeps) -> list[tuple]:
        """Rows of home, shard, blob: what each home's contexts gain (in the first sweep, and their names), and, with home -1, the totals."""
        change, totals = sweeps.change(), sweeps.totals()
        at = np.flatnonzero(totals)
        named = () if len(sweeps.kept) > 1 else (sweeps.asked,)
        return [(-1, shard, squeeze(at, totals[at])), *((home, shard, squeeze(change[mine], *(x[mine] for x in named))) for home, mine in by_shard(sweeps.asked ^ WHOLE, shards))]

    def summed(shard: int, blob: bytes) -> np.ndarray:
        out = np.zeros(CONTEXTS + 2)
        at, x = unsqueeze(blob)
        out[at] = x
        return out

    for sweep in range(BURN_IN + KEPT):

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, lean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield bundles(swept(shard, Sweeps(shard, lean, world)), "home shard blob")
            give_back()

        def later(key: tuple, held: pa.Table, got: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            rows = swept(shard, Sweeps(shard, held.column("lean")[0].as_py(), world, lambda asked: _told(got, asked, shards)))
            give_back()
            return pa.Table.from_batches([bundles(rows, "home shard blob")])

        def reply(key: tuple, table: pa.Table) -> pa.Table:
            """The tables of each sender's contexts, in the order sent: the first sweep has their names."""
            change, names = {}, {}
            for of, shard, blob in sorted(zip(*(table.column(c).to_pylist() for c in ("of", "shard", "blob")), strict=True), key=lambda x: x[0]):
                change[shard], *named = unsqueeze(blob)
                names.update((shard, x) for x in named)
            known, at = np.unique(np.concatenate([names[shard] for shard in change]), return_inverse=True)
            tables = np.bincount(at, np.concatenate(list(change.values())), len(known)).astype(np.int64)
            parts = np.split(tables[at], np.cumsum([len(x) for x in change.values()])[:-1])
            rows = [(shard, sweep, key[0].as_py(), squeeze(part)) for shard, part in zip(change, parts, strict=True)]
            give_back()
            return pa.Table.from_batches([bundles(rows, "shard sweep home blob")])

        lean = counts.select("shard", "lean")
        schema = "home long, shard long, blob binary"
        rows = cut(lean.mapInArrow(first, schema) if told is None else lean.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(later, schema), "sweep")
        totals = _sums(rows.where("home < 0"), summed, CONTEXTS + 2)
        totals[:CONTEXTS] = world["C"] - totals[:CONTEXTS]
        own = rows.where("home >= 0").withColumn("of", F.lit(sweep))
        named = own if told is None else named
        both = own if told is None else named.unionByName(own)
        answers = cut(both.groupBy("home").applyInArrow(reply, "shard long, sweep long, home long, blob binary"), "told")
        told = answers if told is None else told.unionByName(answers)
        world["totals"].append(totals)
    world["told"] = told
    return counts, world


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long), held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of every row.

    Tokens are the A-Z lower-cased words and one end. base_score adds 0.1 to each count; score is the model's, perplexity
    10 ** (-score / n_tokens). A null text is empty (one token). Rows without an id are held out; repeated ids stay rows. An
    empty table gives an empty table.
    """
    shards = shard_count(docs, DOCS_PER_SHARD)
    packs = build_packs(docs, id_col, text_col)
    counts, world = fit(packs, shards)
    told = world.pop("told")
    sent = docs.sparkSession.sparkContext.broadcast(world)

    def answer(key: tuple, held: pa.Table, told: pa.Table) -> pa.Table:
        """For each asked word its count, and of each kept sweep its customers and tables in the parent and, unless it is an owner, its context's tables; for each asked pair its customers, and how many fewer tables it has in all kept sweeps."""
        world, rows, shard = sent.value, [], key[0].as_py()
        seating = Seating(shard, held.column("blob")[0].as_py(), world | {"totals": world["totals"][:-1]}, lambda own: _told(told, own, shards))
        sweeps = seating.sweeps
        below = [seating.count.copy() for _ in range(KEPT)]
        for x, tables in zip(below, sweeps.told[BURN_IN:], strict=len(sweeps.asked) > 0):
            x[np.flatnonzero(seating.count > 1)[sweeps.own]] = tables[sweeps.own_at]
        # as differences, which are mostly zero
        facts = [seating.count, *(x for _, customers, above in seating.kept[BURN_IN:] for x in (seating.count - customers, customers - above)), *(seating.count - x for x in below)]
        of_pairs = seating.pair_n, KEPT * seating.pair_n - sum(t for t, _, _ in seating.kept[BURN_IN:])
        known_words, known_pairs, asked = asked_of(held.column("asks")[0].as_py())

        def spread_out(x: np.ndarray, known: np.ndarray) -> np.ndarray:
            """x over all asked, with zeros for what was not learned."""
            out = np.zeros(len(known), np.int64)
            out[known] = x
            return out

        facts, of_pairs = [spread_out(x, known_words) for x in facts], [spread_out(x, known_pairs) for x in of_pairs]
        for pack, word, pair in asked:
            rows.append((pack, shard, squeeze(*(x[word] for x in facts), *(x[pair] for x in of_pairs))))
        give_back()
        return pa.Table.from_batches([bundles(rows, "pack shard answer")])

    answers = counts.select("shard", "blob", "asks").groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(answer, "pack long, shard long, answer binary")

    def score(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        world = sent.value
        ids, texts = own.column("ids")[0].as_py(), texts_of(own.column("blob")[0].as_py())
        word, spread, place, _ = distinct_pairs(texts, world["owner"])
        first = np.cumsum(spread) - spread
        facts, n = [np.zeros(len(word), np.int64) for _ in range(1 + 3 * KEPT)], np.zeros((2, len(place)))
        blobs = dict(zip(got.column("shard").to_pylist(), got.column("answer").to_pylist(), strict=True))
        for shard, at in by_shard(_idents(word), shards):
            *told, some, less = unsqueeze(blobs.pop(shard))
            n[:, ranges(first[at], spread[at])] = some, less
            for fact, x in zip(facts, told, strict=True):
                fact[at] = x
        count, below, of = facts[0], [facts[0] - x for x in facts[1 + 2 * KEPT :]], np.repeat(np.arange(len(word)), spread)
        parents = []
        for k, total in enumerate(world["totals"][BURN_IN:]):
            customers = count - facts[1 + 2 * k]
            parents.append(parent_probability(customers, customers - facts[2 + 2 * k], total, world)[of])
        # a context that is no owner's is a word of the pack
        ident = _idents(word)
        order, other = np.argsort(ident), place >= WHOLE
        before = order[np.searchsorted(ident, place[other] ^ WHOLE, sorter=order)]
        slot = np.where(other, U(OTHER), place).astype(np.int64)
        customers, tables = world["C"][slot], [total[slot] for total in world["totals"][BURN_IN:]]
        customers[other] = count[before]
        for x, fact in zip(tables, below, strict=True):
            x[other] = fact[before]
        probability = predictive(world, slot, n[0], [n[0] - n[1] / KEPT] * KEPT, parents, (customers, tables))
        base = np.log10((count + 0.1) / (world["N"] + 0.1 * (world["V"] + 1)))
        log = np.log10(probability)
        rows = {"doc_id": ids, "held_out": [not learns(i) for i in ids], "n_tokens": [], "n_known": [], "train_tokens": [world["N"]] * len(ids), "base_score": [], "score": []}
        rank = np.unique(place)
        pairs = of * len(rank) + np.searchsorted(rank, place)
        for _, part in runs(texts):
            size = len(part)
            doc, hashed, after = _walk(part)
            at = np.searchsorted(word, hashed)
            where = np.searchsorted(pairs, at * len(rank) + np.searchsorted(rank, places(after, world["owner"])))
            rows["n_tokens"] += np.bincount(doc, minlength=size).tolist()
            rows["n_known"] += np.bincount(doc, count[at] > 0, size).astype(np.int64).tolist()
            rows["base_score"] += np.bincount(doc, base[at], size).tolist()
            rows["score"] += np.bincount(doc, log[where], size).tolist()
        rows["perplexity"] = (10.0 ** (-np.array(rows["score"]) / np.maximum(rows["n_tokens"], 1))).tolist()
        give_back()
        return pa.table(rows, pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]))

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
