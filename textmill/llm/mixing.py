"""Problem 7: mixing sources to target shares by min-cost flow.

Documents are aggregated by the set of sources they belong to. From each such set, tokens flow to its sources; the r-th use of a
document costs r - 1 a token (convex: second uses are taken only where first ones are used up), no source gets more than its quota, and a
document is used for a source max_repeats times at most. The flow over this small graph is solved exactly on the driver; documents are then picked
in a seeded order until their tokens make up what the flow takes.
"""

from __future__ import annotations

import base64
import heapq
import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, small, spread

#: Fixed value: the split pattern that belongs to the public byte-level ranks.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def token_counts(docs: DataFrame, text_col: str, ranks_file: str) -> DataFrame:
    """docs without the text, with n_tokens (0 for null or empty). The rank file is read on the driver and sent to the workers."""
    keys = [f for f in docs.schema if f.name != text_col]
    with open(ranks_file, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encode = _encoding(ranks.value).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keys), pa.array(counts, pa.int64())], names=[*(f.name for f in keys), "n_tokens"])

    return spread(docs).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "n_tokens long"]))


def min_cost_flow(edges: list[tuple[int, int, int, int]], n: int, source: int, sink: int) -> list[int]:
    """The flow on each edge (from, to, capacity, cost) of a maximum flow of least cost: shortest augmenting paths with potentials."""
    to, left, price, near = [], [], [], [[] for _ in range(n)]
    for a, b, c, p in edges:
        for x, y, z, w in ((a, b, c, p), (b, a, 0, -p)):
            near[x].append(len(to))
            to.append(y)
            left.append(z)
            price.append(w)
    height = [0] * n
    while True:
        far, via = [math.inf] * n, [-1] * n
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in near[x]:
                if left[e] and d + price[e] + height[x] - height[to[e]] < far[to[e]]:
                    far[to[e]], via[to[e]] = d + price[e] + height[x] - height[to[e]], e
                    heapq.heappush(heap, (far[to[e]], to[e]))
        if via[sink] < 0:
            return [left[2 * k + 1] for k in range(len(edges))]
        height = [h + f if f < math.inf else h for h, f in zip(height, far)]
        push, x = math.inf, sink
        while x != source:
            push, x = min(push, left[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != source:
            left[via[x]] -= push
            left[via[x] ^ 1] += push
            x = to[via[x] ^ 1]


def route(supply: dict[tuple[str, ...], int], share: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that flow from each set of sources to each of its sources.

    total: the size of the mixture. By default the largest one at which every source that has any document reaches its share; the shares of
    sources without documents go to the others in proportion.
    """
    patterns = [p for p in supply if supply[p] > 0]
    there = sorted({s for p in patterns for s in p if share.get(s, 0) > 0 and repeats.get(s, 0) > 0})
    if not there:
        return {}
    scale = sum(share[s] for s in there)

    def flow(size: int) -> tuple[dict, bool]:
        node = {p: 1 + k for k, p in enumerate(patterns)}
        at = {s: 1 + len(patterns) + k for k, s in enumerate(there)}
        sink = 1 + len(patterns) + len(there)
        edges = []
        for p in patterns:
            for r in range(max((repeats[s] for s in p if s in at), default=0)):
                edges.append((0, node[p], supply[p], r))
        middle = [(p, s) for p in patterns for s in p if s in at]
        first = len(edges)
        edges += [(node[p], at[s], supply[p] * repeats[s], 0) for p, s in middle]
        quotas = [int(size * share[s] / scale) for s in there]
        edges += [(at[s], sink, q, 0) for s, q in zip(there, quotas)]
        got = min_cost_flow(edges, sink + 1, 0, sink)
        return {k: f for k, f in zip(middle, got[first : first + len(middle)]) if f}, sum(got[-len(there) :]) == sum(quotas)

    if total is not None:
        return flow(total)[0]
    low, high = 0, sum(supply[p] * max((repeats[s] for s in p if s in at_), default=0) for at_ in [set(there)] for p in patterns) + 1
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        low, high = (middle, high) if flow(middle)[1] else (low, middle)
    return flow(low)[0]


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "sources", ranks_file: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", total: int | None = None, seed: int = 42, bucket_docs: int = 20_000, max_sources: int = 10_000) -> DataFrame:
    """<id>, source, n_tokens, uses: how often each document is used for a source; documents that are not used have no row.

    docs: id (unique), text, and `sources`, an array of the sources it belongs to. targets: source, target_share, max_repeats. Documents with a null, empty or
    unlisted source, without tokens or with a null id are not used. A source's tokens pass its quota by less than one document.
    """
    goals = [r for r in small(targets, max_sources, "mix(): sources") if r["source"] is not None]
    share = {r["source"]: float(r["target_share"] or 0) for r in goals}
    repeats = {r["source"]: int(r["max_repeats"] or 0) for r in goals}
    listed = F.array_sort(F.array_distinct(F.filter(F.col(sources_col), lambda s: s.isin(list(share)))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), listed.alias("sources"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("sources") > 0) & (F.length("text") > 0))
    sized = cut(token_counts(rows, "text", ranks_file).where("n_tokens > 0").withColumn("place", F.xxhash64("id", F.lit(seed))))
    sums = small(sized.groupBy("sources").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), max_sources, "mix(): sets of sources")
    supply = {tuple(r["sources"]): r["tokens"] for r in sums}
    flows = route(supply, share, repeats, total)

    # Along the seeded order of a set's documents, repeated as often as needed, each source owns an interval of tokens.
    spans, passed = [], dict.fromkeys(supply, 0)
    for (p, s), tokens in sorted(flows.items()):
        spans.append((list(p), s, supply[p], passed[p], passed[p] + tokens))
        passed[p] += tokens
    plan = docs.sparkSession.createDataFrame(spans, "sources array<string>, source string, supply long, begin long, stop long")
    # Running sums in two steps: over buckets of the order, then within a bucket, so that no task holds a whole source.
    bits = max(0, math.ceil(math.log2(max(1, max((r["docs"] for r in sums), default=1) / bucket_docs))))
    sized = sized.withColumn("bucket", F.shiftrightunsigned("place", 64 - bits) if bits else F.lit(0).cast("long")).withColumn("order", F.col("place").bitwiseXOR(F.lit(-(1 << 63))))
    by_bucket = sized.groupBy("sources", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = by_bucket.select("sources", "bucket", (F.sum("t").over(Window.partitionBy("sources").orderBy("bucket")) - F.col("t")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("sources", "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    at = sized.withColumn("inside", inside).join(before, ["sources", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    # The number of k >= 0 with begin <= at + k * supply < stop.
    up_to = lambda end: F.greatest(F.lit(0), F.ceil((F.col(end) - F.col("at")) / F.col("supply")))
    used = at.join(F.broadcast(plan), "sources").withColumn("uses", (up_to("stop") - up_to("begin")).cast("int")).where("uses > 0")
    return used.select(F.col("id").alias(id_col), "source", "n_tokens", "uses")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, n_docs, most_uses: for every target source, with zeros where nothing was used."""
    each = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    out = targets.select("source", "target_share").join(each, "source", "left").withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row per source
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "n_docs", "most_uses")))
