"""Set similarity: exact joins by prefix filtering, MinHash signatures, banding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltflow.operators.lineage import cut
from siltflow.operators.spread import pairs_within

#: A prime modulus below 2**31, so that products of two residues fit a long.
PRIME = 2147483647


def hash_coefficients(n: int, seed: int = 553) -> list[tuple[int, int]]:
    """n pairs (a, b) with 1 <= a, b < PRIME from a linear congruential sequence: literal values, so that a query and its SQL
    twin agree."""
    out, x = [], seed
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % (1 << 31)
            pair.append(x % (PRIME - 1) + 1)
        out.append(tuple(pair))
    return out


def linear_hash(x: Column, a: int, b: int, p: int = PRIME) -> Column:
    return (x * F.lit(a) + F.lit(b)) % F.lit(p)


def shingles(df: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """(item, token): the distinct word k-grams of each text, as text; shorter texts have none."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "")
    w = df.select(F.col(key).alias("item"), words.alias("w"))
    grams = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")))
    return w.select("item", F.explode(F.array_distinct(grams)).alias("token"))


def jaccard_join(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) for items a < b of a long form (item, token) with |A ∩ B| / |A ∪ B| >= threshold > 0, exactly.

    Tokens are ordered rare first; two sets that reach the threshold share a token among the first n - ceil(t * n) + 1, and
    their sizes differ by at most the factor t. So only prefixes are joined, on rare tokens, and the sets themselves are
    compared once per candidate; equal sets are one until the end. Until then a token is a 64-bit hash, and tokens of one set only are counted and not moved
    again; equal hashes of different tokens make a candidate more.
    """
    sets = sets.where("item IS NOT NULL AND token IS NOT NULL")
    hashed = sets.select("item", F.xxhash64("token").alias("h")).groupBy("item").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    hashed = cut(hashed.withColumn("key", F.sha2(F.array_join("hs", ","), 256)))
    members = collapse(hashed)
    first = hashed.join(members.where("item = rep"), "item", "left_semi")
    by_token = first.select(F.explode("hs").alias("h"), "item", F.size("hs").alias("n"))
    shared = by_token.withColumn("f", F.count("*").over(Window.partitionBy("h"))).where("f > 1")
    by_item = Window.partitionBy("item")
    place = F.col("n") - F.count("*").over(by_item) + F.row_number().over(by_item.orderBy("f", "h"))
    prefix = shared.select("item", "h", "n", place.alias("pos")).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    met, _ = pairs_within(cut(prefix.select("h", "item", "n")), "h", "item", ("n",))
    near = (F.col("a_n") >= F.col("b_n") * threshold - 1e-9) & (F.col("b_n") >= F.col("a_n") * threshold - 1e-9)
    return expand(verify(met.where(near).select("a", "b").distinct(), sets, threshold), members)


def collapse(df: DataFrame) -> DataFrame:
    """(item, rep) of rows (item, key): the least item with the same key."""
    return cut(df.join(df.groupBy("key").agg(F.min("item").alias("rep")), "key").select("item", "rep"))


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs a < b of representatives, for all that they represent, and the pairs within a representative's members; with a
    similarity, that of those is 1."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    m = members.select(F.col("rep").alias("a"), F.col("item").alias("x")), members.select(F.col("rep").alias("b"), F.col("item").alias("y"))
    across = pairs.join(m[0], "a").join(m[1], "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *rest)
    within, _ = pairs_within(members, "rep", "item")
    return across.unionByName(within.select("a", "b", *[F.lit(1.0).alias(c) for c in rest]))


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) with their exact similarity, those at or above the threshold. Only sets of candidates are
    gathered."""
    pairs = cut(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    whole = sets.join(named, "item", "left_semi").groupBy("item").agg(F.collect_set("token").alias("t"))
    both = pairs.join(whole.select(F.col("item").alias("a"), F.col("t").alias("ta")), "a").join(whole.select(F.col("item").alias("b"), F.col("t").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", (common / (F.size("ta") + F.size("tb") - common)).alias("sim")).where(F.col("sim") >= threshold)


def minhash(sets: DataFrame, token: Column, n: int = 60, modulus: int | None = None, seed: int = 553, more: list[Column] | None = None) -> DataFrame:
    """(item, sig): for each of n linear hashes of the numeric token its least value over the item's set. One aggregation with n
    minima, combined per task before the shuffle; no row per hash. `more` are aggregates of the tokens beside it."""
    hashed = sets.select("item", token.alias("x"), *["token"] * bool(more))

    def h(a, b):
        v = linear_hash(F.col("x"), a, b)
        return v % F.lit(modulus) if modulus else v

    return hashed.groupBy("item").agg(F.array(*[F.min(h(a, b)) for a, b in hash_coefficients(n, seed)]).alias("sig"), *(more or []))


def bands(signatures: DataFrame, rows: int = 2) -> DataFrame:
    """(item, band, key): a row per band of `rows` signature entries."""
    n = F.size("sig") / rows
    cut = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(i.alias("band"), F.slice("sig", i * rows + 1, rows).alias("key")))
    return signatures.select("item", F.inline(cut))


def candidates(signatures: DataFrame, rows: int = 2) -> DataFrame:
    """Pairs a < b that agree in a band; each item is in one row per band, so pairs meet by an equi-join, in as many tasks as
    their number demands. Items with equal signatures are one until the end."""
    signatures = cut(signatures)
    members = collapse(signatures.select("item", F.col("sig").alias("key")))
    return expand(banded(signatures.join(members.where("item = rep"), "item", "left_semi"), rows), members)


def banded(signatures: DataFrame, rows: int) -> DataFrame:
    b = bands(signatures, rows).select("item", F.concat(F.array(F.col("band").cast("long")), "key").alias("key"))
    return pairs_within(b, "key", "item")[0].distinct()


def lsh_join(sets: DataFrame, token: Column, threshold: float = 0.5, n: int = 60, rows: int = 2) -> DataFrame:
    """Pairs by MinHash banding, verified exactly: every row is right, and a pair at similarity s is found with probability
    1 - (1 - s**rows)**(n / rows). Equal sets, by signature, size and sums of two hashes of 40 bits, are one until the end."""
    sums = [F.count("*").alias("n"), *[F.sum(F.pmod(F.xxhash64("token", F.lit(i)), F.lit(1 << 40))).alias(f"s{i}") for i in (1, 2)]]
    signatures = cut(minhash(sets.select("item", "token"), token, n, more=sums))
    members = collapse(signatures.select("item", F.struct("sig", "n", "s1", "s2").alias("key")))
    first = signatures.join(members.where("item = rep"), "item", "left_semi").select("item", "sig")
    return expand(verify(banded(first, rows), sets, threshold), members)
