"""UMIs and molecules: votes per cluster, clustering, consensus input, saturation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.operators.relational import samples


def vote_clusters(cands: DataFrame, least: int = 2) -> DataFrame:
    """Isoform and circle support after one vote per molecule.

    cands: cluster_id, circ_id, isoform_id. Each cluster counts once, for its most
    frequent (circ, isoform), the least of equal ones; rows of the empty cluster go.
    One row per isoform whose own or whose circle's support reaches ``least``."""
    rows = cands.where("cluster_id is not null and cluster_id <> ''").groupBy("cluster_id", "circ_id", "isoform_id").agg(F.count("*").alias("n"))
    top = rows.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("r"), "circ_id", "isoform_id")).alias("b")).select("cluster_id", "b.circ_id", "b.isoform_id")
    iso = top.groupBy("circ_id", "isoform_id").agg(F.count("*").alias("n_umi"))
    site = iso.groupBy("circ_id").agg(F.sum("n_umi").alias("circ_umi"))
    out = iso.join(site, "circ_id").where(F.col("circ_umi") >= least)
    return out.withColumn("confident", F.col("n_umi") >= least)


def with_clusters(cands: DataFrame, clusters: DataFrame) -> DataFrame:
    """cands (read_id, ...) with cluster_id, '' where the read is in no cluster (read_id, cluster_id)."""
    return cands.join(clusters.select("read_id", "cluster_id"), "read_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit("")))


def candidate_tables(votes: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of vote_clusters: the isoforms (circ_id, isoform_id, n_umi) that have enough molecules, and the circles
    (circ_id, circ_umi) that have, whatever their isoforms."""
    iso = votes.where(F.col("n_umi") >= least).select("circ_id", "isoform_id", "n_umi")
    return iso, votes.where(F.col("circ_umi") >= least).select("circ_id", "circ_umi").distinct()


def cluster_rows(members: DataFrame) -> DataFrame:
    """cluster_no, idx, len, read_id, identity (null: the representative) of clustered reads (read_id, seq,
    representative, identity): clusters by length of their representative, longest first, then by its letters; in a cluster the
    representative comes first, the others by length and read."""
    from ringloom.operators.relational import numbered

    reps = members.select("representative").distinct().withColumn("_l", -F.length("representative"))
    d = members.join(numbered(reps, ["_l", "representative"], "cluster_no").drop("_l"), "representative")
    first = F.when(F.col("seq") == F.col("representative"), F.col("read_id"))
    d = d.withColumn("_head", F.min(first).over(Window.partitionBy("cluster_no")))
    lead = (F.col("read_id") == F.col("_head")) & (F.col("seq") == F.col("representative"))
    idx = F.row_number().over(Window.partitionBy("cluster_no").orderBy((~lead).cast("int"), F.desc(F.length("seq")), "read_id")) - 1
    return d.select("cluster_no", idx.alias("idx"), F.length("seq").alias("len"), "read_id", F.when(~lead, F.col("identity")).alias("identity"))


def n50(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: n, total and the length that sequences of it and more make up half of the total with."""
    by = seqs.select(F.length(seq).cast("long").alias("len")).where("len is not null").groupBy("len").agg(F.count("*").alias("m"))
    w = Window.orderBy(F.desc("len"))  # a row per length, not per sequence
    d = by.withColumn("run", F.sum(F.col("len") * F.col("m")).over(w)).withColumn("all", F.sum(F.col("len") * F.col("m")).over(Window.partitionBy()))
    return d.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.max("all"), F.lit(0)).alias("total"), F.max(F.when(2 * F.col("run") >= F.col("all"), F.col("len"))).alias("n50"))


def molecule_segments(ccs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Segments of all reads of a cluster in a fixed order: cluster_id, n_reads, segments.
    ccs: read_id, segments (array of strings). Reads outside clusters go."""
    d = ccs.join(clusters, "read_id").select("cluster_id", "read_id", F.posexplode("segments").alias("i", "segment"))
    return d.groupBy("cluster_id").agg(F.countDistinct("read_id").alias("n_reads"), F.count("*").alias("n_segments"), F.sum(F.length("segment")).alias("n_bases"))


def saturation(reads: DataFrame, sizes: Sequence[int], repeats: int, unit: str = "read_id") -> DataFrame:
    """sample_size, rep, total_len, n_circ over samples without replacement.
    reads: read_id, len, circ_id (null where the read has none). unit: what is
    sampled, read_id or a molecule's column, whose reads then come together."""
    picked = samples(reads.select(unit).where(F.col(unit).isNotNull()).distinct(), unit, sizes, repeats)
    return picked.join(reads, unit).groupBy("sample_size", "rep").agg(F.sum("len").alias("total_len"), F.countDistinct("circ_id").alias("n_circ"))


def skipping_kmers(seqs: DataFrame, k: int, squeezed: bool = False) -> DataFrame:
    """(id, pos, kmer) of every k letters in a row among the ACGT of a sequence, other letters being skipped; squeezed: of a
    run of one letter only the first counts. pos (from 0) is where the last letter stands."""
    bare = F.regexp_replace("seq", "[^ACGT]", "")
    d = seqs.where(F.length("seq") > 0).withColumn("_s", F.regexp_replace(bare, r"(.)\1+", "$1") if squeezed else bare)
    d = d.where(F.length("_s") >= k).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_s") - k + 1)))
    # the place of a word's last letter: behind as many kept letters as come before it
    # (letters that are skipped do not end a run)
    kept = "[^ACGT]*(?:A[^CGT]*|C[^AGT]*|G[^ACT]*|T[^ACG]*)" if squeezed else "[^ACGT]*[ACGT]"
    before = F.call_function("regexp_extract", F.col("seq"), F.concat(F.lit(f"^((?:{kept}){{"), (F.col("_i") + k - 2).cast("string"), F.lit("}[^ACGT]*)")), F.lit(1))
    return d.select("id", F.length(before).alias("pos"), F.substring("_s", F.col("_i"), F.lit(k)).alias("kmer"))


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(id, pos, kmer) of every k-mer of ACGT alone; pos from 0."""
    at = F.sequence(F.lit(1), F.length("seq") - k + 1)
    grams = F.transform(F.when(F.length("seq") >= k, at), lambda i: F.substring(F.col("seq"), i, F.lit(k)))
    return seqs.select("id", F.posexplode(grams).alias("pos", "kmer")).where(~F.col("kmer").rlike("[^ACGT]"))


#: A block of shared_words holds about as many sequences, and as many letters, at most.
BLOCK, LETTERS = 1 << 15, 1 << 22


def shared_words(seqs: DataFrame, k: int, least: int) -> DataFrame:
    """Pairs (a < b) that share at least ``least`` words, counted with the smaller
    multiplicity of the two.

    Sequences are dealt into blocks by hash, and a task counts the words of one pair of blocks: what lies
    on disk are the sequences, once for each block, never pairs or words; a frequent word is no hot key."""
    d = seqs.where("id is not null and seq is not null").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("seq")), "\n").alias("seq"))
    n, letters = d.agg(F.count("*"), F.sum(F.length("seq"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(letters or 0) // LETTERS))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    d = d.withColumn("_x", own).withColumn("_y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    d = d.select("id", "seq", F.least("_x", "_y").alias("_p"), F.greatest("_x", "_y").alias("_q"), F.when(F.col("_x") <= F.col("_y"), 0).otherwise(1).alias("_right"))
    tasks = min(blocks * (blocks + 1) // 2, 4096)
    kind = d.schema["id"].dataType.simpleString()
    d = d.repartition(tasks, "_p", "_q").sortWithinPartitions("_p", "_q", "_right")
    return d.mapInArrow(_shared(k, least), f"a {kind}, b {kind}, shared long")


def _features(seqs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, word, how many of the word came before) of each word of ACGT alone, by sequence and word."""
    code = np.full(256, -1, np.int64)
    code[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    texts = [s.encode("latin-1", "replace") for s in seqs.to_pylist()]
    x = code[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    whose = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    n = max(0, len(x) - k + 1)
    word, good = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        word = word << 2 | np.maximum(x[i : n + i], 0)
        good &= x[i : n + i] >= 0
    word, whose = word[good], whose[:n][good]
    at = np.lexsort((word, whose))
    word, whose = word[at], whose[at]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[1:] != word[:-1]) | (whose[1:] != whose[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(word)), 0))
    return whose, word, np.arange(len(word)) - first


def _shared(k: int, least: int):
    def pairs(left: pa.Table, right: pa.Table, same: bool):
        (lw, lword, lrep), (rw, rword, rrep) = _features(left["seq"], k), _features(right["seq"], k)
        # a word's second occurrence is another feature than its first, so common features make the smaller counts
        most = int(max(lrep.max(initial=0), rrep.max(initial=0))) + 1
        kinds, rows = np.unique(rword * most + rrep, return_inverse=True)
        order = np.argsort(rows, kind="stable")
        rows, begin = rw[order], np.searchsorted(rows[order], np.arange(len(kinds) + 1))
        mine = lword * most + lrep
        at = np.searchsorted(kinds, mine)
        met = (at < len(kinds)) & (kinds[np.minimum(at, max(len(kinds) - 1, 0))] == mine) if len(kinds) else np.zeros(len(mine), bool)
        at, lw = at[met], lw[met]
        cut = np.searchsorted(lw, np.arange(left.num_rows + 1))
        ids, peers = left["id"].combine_chunks(), right["id"].combine_chunks()
        a, b, c, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            x, y, z = ids.take(pa.array(np.concatenate(a))), peers.take(pa.array(np.concatenate(b))), pa.array(np.concatenate(c).astype(np.int64))
            up = pc.less(x, y)
            low, high = (x, y) if same else (pc.if_else(up, x, y), pc.if_else(up, y, x))
            got = pa.RecordBatch.from_arrays([low, high, z], ["a", "b", "shared"])
            return got.filter(up) if same else got

        for i in range(left.num_rows):
            f = at[cut[i] : cut[i + 1]]
            if len(f) < least:
                continue
            n = np.bincount(np.concatenate([rows[begin[j] : begin[j + 1]] for j in f.tolist()]), minlength=right.num_rows)
            hit = np.flatnonzero(n >= least)
            a.append(np.full(len(hit), i))
            b.append(hit)
            c.append(n[hit])
            size += len(hit)
            if size > 1 << 19:
                yield out()
                a, b, c, size = [], [], [], 0
        if size:
            yield out()

    def group(key: tuple[int, int], parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        left, right = (t.filter(pc.equal(t["_right"], i)) for i in (0, 1))
        yield from pairs(left, left, True) if key[0] == key[1] else pairs(left, right, False)

    def run(batches):
        key, parts = None, []
        for b in batches:
            p, q = b.column("_p").to_numpy(), b.column("_q").to_numpy()
            ends = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist(), len(p)]
            for lo, hi in zip(ends, ends[1:], strict=False):
                if hi > lo:
                    own = int(p[lo]), int(q[lo])
                    if own != key and parts:
                        yield from group(key, parts)
                        parts = []
                    key = own
                    parts.append(b.slice(lo, hi - lo))
        if parts:
            yield from group(key, parts)

    return run


def kde_peak(values: DataFrame, group: str, value: str) -> DataFrame:
    """Group's value of highest Gaussian density (bandwidth n ** -0.2, the least
    of equal ones), density rounded to 9 digits, and how many values equal it."""
    c = values.groupBy(group, value).agg(F.count("*").alias("n"))
    size = c.groupBy(group).agg(F.sum("n").alias("all"))
    peer = c.select(group, F.col(value).alias("_y"), F.col("n").alias("_m"))
    z = (F.col(value) - F.col("_y")) / F.pow(F.col("all").cast("double"), F.lit(-0.2))
    d = c.join(size, group).join(peer, group).groupBy(group, value, "n").agg(F.round(F.sum(F.col("_m") * F.exp(-0.5 * z * z)), 9).alias("density"))
    best = d.groupBy(group).agg(F.min(F.struct((-F.col("density")).alias("d"), F.col(value).alias("peak"), F.col("n").alias("support"))).alias("b"))
    return best.select(group, "b.peak", "b.support", (-F.col("b.d")).alias("density"))


def identities(first: list[str], second: list[str], band: int = 20) -> np.ndarray:
    """Matches on the best global path over the length of the shorter sequence, of each pair.
    Match 2, mismatch -2, gap -6 and -1 further; gaps at the ends cost -1 each. Of equal scores the path with
    more matches counts. Pairs of equal lengths are aligned together, a row of all of them at a time."""
    out = np.zeros(len(first))
    groups: dict[tuple[int, int], list[int]] = {}
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(first, second, strict=True)]
    for i, (x, y) in enumerate(pairs):
        groups.setdefault((len(x), len(y)), []).append(i)
    one, low = 1 << 20, -(1 << 50)  # a point of score, above the count of matches in the bits below
    for (n, m), own in groups.items():
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            if not n:
                continue
            x, y = (np.frombuffer("".join(pairs[i][k] for i in part).encode("latin-1", "replace"), np.uint8).reshape(len(part), -1) for k in (0, 1))
            j = np.arange(m + 1, dtype=np.int64)
            best = np.broadcast_to(-j * one, (len(part), m + 1))
            up = left = np.full((len(part), m + 1), low)
            for i in range(1, n + 1):
                lo, hi = max(1, i - band), min(m, i + band + m - n)
                same = x[:, i - 1, None] == y[:, lo - 1 : hi]
                top = np.maximum(np.maximum(best, up), left)
                mt, nu, nl = (np.full((len(part), m + 1), low) for _ in range(3))
                mt[:, 0] = -i * one
                mt[:, lo : hi + 1] = top[:, lo - 1 : hi] + np.where(same, 2 * one + 1, -2 * one)
                edge = np.where(j[lo : hi + 1] == m, -1, -6) * one
                nu[:, lo : hi + 1] = np.maximum(best[:, lo : hi + 1] + edge, up[:, lo : hi + 1] - one)
                # gaps along the longer one: a running maximum of where they open
                opened = np.maximum.accumulate((mt + j * one)[:, lo - 1 : hi], axis=1)
                nl[:, lo : hi + 1] = opened + ((-1 if i == n else -6) - (j[lo : hi + 1] - 1)) * one
                best, up, left = mt, nu, nl
            end = np.maximum(np.maximum(best, up), left)[:, m]
            out[part] = (end & (one - 1)) / n
    return out


def _linked(least: float):
    def run(batches):
        for b in batches:
            ok = identities(b.column("sa").to_pylist(), b.column("sb").to_pylist())
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.float64())], ["a", "b", "identity"])
            yield out.filter(pa.array(ok >= least))

    return run


def _words(seq: Column, k: int) -> Column:
    at = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substring(seq, i, F.lit(k))), lambda w: ~w.rlike("[^ACGT]")))


def _need(size: Column, least: float, k: int) -> Column:
    """How many words a sequence of this length shares with a similar one at least."""
    return F.greatest(F.lit(1), F.floor(size - k + 1 - (1 - least) * size * k)).cast("int")


def _pieces(size: Column, least: float) -> tuple[Column, Column]:
    """(bases without a match that similar sequences of this length may have, the size of their pieces)."""
    off = F.floor((1 - least) * size + 1e-6)
    return off, F.floor(size / (2 * off + 1))


def _piece_pairs(nodes: DataFrame, least: float, k: int) -> DataFrame:
    """Candidates (a, b) of equal lengths, a before b. On a path that leaves at most ``off`` bases of either
    without a match, one of 2 * off + 1 pieces of b is matched whole, at most ``off`` places away in a. Only
    lengths whose pieces are not shorter than k."""
    d = nodes.select("id", F.length("id").alias("_n"), F.regexp_replace("id", r"[^\x00-\xFF]", "?").alias("_t"))
    off, size = _pieces(F.col("_n"), least)
    d = d.withColumns({"_off": off, "_size": size}).where(F.col("_size") >= k).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("_off"))))
    text = lambda at: F.substring("_t", (at + 1).cast("int"), F.col("_size").cast("int"))
    b = d.select(F.col("id").alias("b"), "_n", "_i", text(F.col("_i") * F.col("_size")).alias("_w"))
    a = d.withColumn("_at", F.explode(F.sequence(F.col("_i") * F.col("_size") - F.col("_off"), F.col("_i") * F.col("_size") + F.col("_off"))))
    a = a.where("_at >= 0 and _at + _size <= _n").select(F.col("id").alias("a"), "_n", "_i", text(F.col("_at")).alias("_w"))
    return a.join(b, ["_n", "_i", "_w"]).where("a < b").select("a", "b").distinct()


def _word_pairs(nodes: DataFrame, least: float, k: int) -> DataFrame:
    """Candidates (a, b), a the longer or the first, of any lengths: who shares ``need`` of a sequence's words has one
    of all but need - 1 of them, and the rarest will do."""
    word = nodes.select("id", F.explode(_words(F.col("id"), k)).alias("kmer"))
    rarity = word.groupBy("kmer").agg(F.count("*").alias("m"))
    words = word.join(rarity, "kmer").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "kmer"))), lambda x: x["kmer"]).alias("wb"))
    some = words.withColumn("need", _need(F.length("id"), least, k)).where(F.size("wb") >= F.col("need"))
    some = some.select(F.col("id").alias("b"), F.explode(F.slice("wb", F.lit(1), F.size("wb") - F.col("need") + 1)).alias("kmer"))
    earlier = (F.length("a") > F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    return word.select(F.col("id").alias("a"), "kmer").join(some, "kmer").where(earlier).select("a", "b").distinct()


def cluster_umis(umis: DataFrame, least: float = 0.98, k: int = 8, shortest: int = 10) -> DataFrame:
    """Greedy longest-first clusters: read_id, representative, identity.

    Equal sequences are one node. Nodes are ordered by length (longest first), then
    sequence; a node is a representative unless an earlier representative is similar. That set
    is found in rounds: a node whose earlier neighbours are all decided is decided.
    Members take their most similar representative, the earlier of equal ones."""
    from ringloom.operators.kernels import spread
    from ringloom.operators.storage import materialised

    u = umis.where(F.length("seq") > shortest)
    nodes = materialised(u.select("seq").distinct().select(F.col("seq").alias("id"), "seq"))
    pair = _piece_pairs(nodes, least, k)
    size = _pieces(F.length("id"), least)[1]
    one = nodes.agg(F.min(F.length("id")), F.max(F.length("id")), F.min(size)).first()
    if one[0] != one[1] or one[2] < k:
        pair = pair.union(_word_pairs(nodes, least, k).where((F.length("a") != F.length("b")) | (_pieces(F.length("a"), least)[1] < k)))
    shared = F.size(F.array_intersect(_words(F.col("a"), k), _words(F.col("b"), k)))
    pair = spread(pair.distinct(), "a", "b").where(shared >= _need(F.length("b"), least, k))
    links = pair.select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb")).mapInArrow(_linked(least), "a string, b string, identity double")
    links = materialised(links)
    rep = materialised(nodes.select("id").join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
    member = None
    open_ = links
    while True:
        hit = open_.join(rep.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        member = materialised(hit if member is None else member.union(hit).distinct())
        open_ = materialised(open_.join(member.select(F.col("id").alias("b")), "b", "left_anti").join(member.select(F.col("id").alias("a")), "a", "left_anti"))
        waiting = open_.select(F.col("b").alias("id")).distinct()
        fresh = nodes.select("id").join(member, "id", "left_anti").join(waiting, "id", "left_anti")
        rep = materialised(fresh)
        if open_.isEmpty():
            break
    best = links.join(rep.select(F.col("id").alias("a")), "a", "left_semi").groupBy("b").agg(F.min(F.struct((-F.col("identity")).alias("r"), (-F.length("a")).alias("l"), "a")).alias("best"))
    joined = u.join(best.withColumnRenamed("b", "seq"), "seq", "left")
    return joined.select("read_id", F.coalesce("best.a", "seq").alias("representative"), F.coalesce(-F.col("best.r"), F.lit(1.0)).alias("identity"))
