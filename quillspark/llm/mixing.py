"""Operator 10, mixing sources to target weights: pivotal dependent rounding in a reduction tree.

A document of a source with target t and size s is to be taken t / s times in the mean: the whole part
always, the fraction as a copy probability. In a block of a source's documents each is paired, by falling
size, with the rest of its block, and mass moves between the two until the document's probability is 0 or 1;
documents that outweigh the rest are paired with each other. A block leaves one document undecided, and
blocks of these follow, until a source has one block, where all are decided. The mass that moves is words: what one
side loses of its due words the other gains. So the words of a source stay what they are to be through all of the
tree, but for those of the last document and of such as outweigh all that is left at the root; and each move leaves
every document's expectation as it was. Documents much longer than the others of their source would outweigh any block: they have a tree
of their own, at whose root all the others stand as one, before these are dealt to theirs. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done, matched, n_words, numbered, shielded, sums_before, uniform, written

#: Documents of a block; documents of more than so many times their source's mean size go first.
FAN, HEAVY = 64, 16
#: What stands for all the documents of a source that aren't heavy.
LIGHT = -1


def targets(sizes: DataFrame, source: str = "source", most: float = 3.0) -> DataFrame:
    """Of sizes (source, source_size), the target of each source.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3 ... and share the sum of sizes; none gets more than
    `most` times its size, and what it can't take is shared by weight among the others. That
    is water-filling, target = min(cap, level * weight): the level rises from that of no caps by what the sources over
    their caps can't take, until no more of them get over it. Every round is one sum over the sources, which ranges
    of them have numbered; their number may be that of the documents.
    """
    rows = sums_before(sizes.withColumn("__1", F.lit(1)), [source], "__1", "__rank")
    held = rows.withColumn("__w", F.col("__rank") % 3 + 1).withColumn("__cap", F.col("source_size") * most).drop("__1", "__rank")
    level, over = 0.0, -1
    while True:
        capped = F.col("__cap") < F.lit(level) * F.col("__w")
        said = held.agg(F.sum("source_size").alias("total"), F.sum(F.when(capped, F.col("__cap"))).alias("caps"), F.sum(F.when(~capped, F.col("__w"))).alias("weights"), F.count_if(capped).alias("over")).first()
        if said["over"] == over or not said["total"]:
            break
        over = said["over"]
        level = (said["total"] - (said["caps"] or 0.0)) / said["weights"] if said["weights"] else float("inf")
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("__cap", F.lit(level) * F.col("__w")))
    out = written(held.withColumn("target", target).drop("__w", "__cap"), "mix-targets")
    done(rows)
    return out


def _let(value, of):
    """of(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _held(p):
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def _state(x, p):
    return F.struct(x["g"].alias("g"), x["size"].alias("size"), p.alias("p"))


def _end(x, one):
    return F.struct(x["g"].alias("g"), one.cast("int").alias("one"))


def _pooled(items, seed: int, root: bool = False):
    """An array of (order, g, size, p), in its order, each paired with all that follow: (done, rest, late), late what outweighs its rest.

    A document of the rest gives or takes in proportion to its size and to how far it is from 0 or 1, whichever is
    nearer: as much one way as the other, so that its expectation stays too. At a root what outweighs its rest is
    decided as well, and the rest makes up for as much as it can both ways. What stands for light documents stays as the rest.
    """
    nearer = lambda k: F.least(k["p"], 1 - k["p"])

    def step(s, _):
        rest = F.slice(s["rest"], 2, FAN)
        pool = F.aggregate(rest, F.lit(0.0), lambda n, k: n + k["size"] * nearer(k))
        return _let(F.struct(F.get(s["rest"], F.lit(0)).alias("i"), rest.alias("rest"), pool.alias("pool")), lambda x: moved(s, x))

    def moved(s, x):
        i = x["i"]
        has, lacks = i["p"] * i["size"], (1 - i["p"]) * i["size"]
        up, down = (lacks, has) if root else (F.least(lacks, x["pool"]), F.least(has, x["pool"]))
        # up is drawn with the chance down / (up + down), so each expectation stays
        rises = uniform(i["g"], F.size(x["rest"]), seed=seed) * (up + down) < down
        words = F.when(rises, up).otherwise(-down)
        if root:
            words = words * F.least(F.lit(1.0), x["pool"] / F.greatest(up, down))
        ends = F.lit(True) if root else F.when(rises, lacks <= x["pool"]).otherwise(has <= x["pool"])
        return _let(F.struct(rises.alias("rises"), words.alias("words"), ends.alias("ends")), lambda y: F.struct(
            F.when(y["ends"], F.concat(s["done"], F.array(_end(i, y["rises"])))).otherwise(s["done"]).alias("done"),
            F.transform(x["rest"], lambda k: _state(k, F.when(x["pool"] > 0, _held(k["p"] - y["words"] * nearer(k) / x["pool"])).otherwise(k["p"]))).alias("rest"),
            F.when(y["ends"], s["late"]).otherwise(F.concat(s["late"], F.array(_state(i, _held(i["p"] + y["words"] / i["size"]))))).alias("late"),
        ))

    ends, states = F.array().cast("array<struct<g:bigint,one:int>>"), F.array().cast("array<struct<g:bigint,size:bigint,p:double>>")
    first = F.struct(ends.alias("done"), F.transform(items, lambda k: _state(k, k["p"])).alias("rest"), states.alias("late"))
    steps = F.size(items) - (F.element_at(items, -1)["g"] == LIGHT).cast("int")
    return F.aggregate(F.slice(items, F.lit(1), steps), first, step)


def _paired(items, seed: int):
    """An array of (g, size, p), in its order, each paired with the one that the pairs before it left: (done, i), i the last undecided or null."""

    def pair(s, j):
        i = s["i"]
        has_i, has_j, lacks_i, lacks_j = i["p"] * i["size"], j["p"] * j["size"], (1 - i["p"]) * i["size"], (1 - j["p"]) * j["size"]
        up, down = F.least(lacks_i, has_j), F.least(has_i, lacks_j)  # what j can give to i, and i to j
        rises = uniform(i["g"], j["g"], seed=seed) * (up + down) < down
        i_full, j_full = lacks_i <= has_j, lacks_j <= has_i
        # the other one has gone all the way where i hasn't: i is 1 or j is 0, and i is 0 or j is 1
        i_ends = F.when(rises, i_full).otherwise(~j_full)
        one = F.when(rises, i_full).otherwise(j_full)
        words = F.when(rises, up).otherwise(-down)
        left = F.when(i_ends, _state(j, _held(j["p"] - words / j["size"]))).otherwise(_state(i, _held(i["p"] + words / i["size"])))
        return F.struct(F.concat(s["done"], F.array(F.when(i_ends, _end(i, one)).otherwise(_end(j, one)))).alias("done"), left.alias("i"))

    first = F.struct(F.array().cast("array<struct<g:bigint,one:int>>").alias("done"), F.get(items, F.lit(0)).alias("i"))
    return F.aggregate(F.slice(items, 2, FAN), first, pair)


def _fold(items, seed: int):
    """A block's documents: the decided (g, one) as done, and i, the one that is left, or null."""
    both = lambda x: _let(_paired(x["late"], seed), lambda y: F.struct(F.concat(x["done"], y["done"]).alias("done"), y["i"].alias("i")))
    return _let(_pooled(items, seed), both)


def _item(x, order=None):
    """What a block has of x (g, size, p): the largest first."""
    return F.struct((-x["size"] if order is None else F.lit(order).cast("long")).alias("order"), x["g"].alias("g"), x["size"].alias("size"), x["p"].alias("p")).alias("item")


def _tree(open_: DataFrame, blocks: int, seed: int, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of open_ (s, r, item), s a source, r numbers in it up to blocks: the decided (s, g, one), and (s, i) what is left of more.

    more (s, item), which stands for light documents, takes part at the roots.
    """
    done, level = None, 0
    while True:
        level, blocks = level + 1, -(-blocks // FAN)
        if blocks <= 1 and more is not None:
            open_ = open_.select("s", "r", "item").union(more.select("s", F.lit(0).cast("long"), "item"))
        block = open_.groupBy("s", F.floor(F.col("r") / F.lit(FAN**level)).cast("long").alias("k")).agg(F.min("r").alias("r"), F.sort_array(F.collect_list("item")).alias("a"))
        if blocks <= 1:
            fold = _let(_pooled(F.col("a"), seed + level, True), lambda x: F.struct(x["done"].alias("done"), F.get(x["rest"], F.lit(0)).alias("i")))
        else:
            fold = _fold(F.col("a"), seed + level)
        block = written(block.select("s", "r", fold.alias("f")), "mix-level")
        some = block.select("s", F.explode("f.done").alias("d")).select("s", "d.g", "d.one")
        done = some if done is None else done.union(some)
        left = block.where("f.i is not null").select("s", "r", F.col("f.i").alias("i"))
        if blocks <= 1:
            return done, left.select("s", "i")
        open_ = left.select("s", "r", _item(F.col("i")))


def mix(docs: DataFrame, size: str = "size", source: str = "source", seed: int = 23) -> DataFrame:
    """docs (narrow rows: what names a document, its size and source) with source_size, target, copies.

    Words taken are size * copies. Each document has target / source_size copies in the mean, and the words taken
    of a source differ from its target by less than those of one document. copies is at most 3. The result depends on the
    rows and the seed alone. Documents of size 0 and those of sources of size 0 get the copies of their
    source's fraction drawn one by one (they add no words). A null source is a source; null sizes count
    as 0; equal rows are drawn each by itself; an empty table gives no rows. The columns made replace columns of their names.
    """
    docs, (size, source), back = shielded(docs.drop("source_size", "target", "copies"), size, source)
    docs = docs.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
    rows = plain = numbered(docs, "__g", [source], seed)
    sizes = rows.groupBy(source).agg(F.sum(size).alias("source_size"), F.min("__g").alias("__s"), F.count(F.lit(1)).alias("__m"))
    aim = targets(sizes, source)
    rows = matched(rows, aim, [source])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__x", each).withColumn("__whole", F.floor("__x").cast("int"))
    rows = written(rows.withColumn("__p", F.col("__x") - F.col("__whole")), "mix-aim")
    free = rows.where((F.col(size) > 0) & (F.col("__p") > 0)).withColumn("__heavy", F.col(size).cast("double") * F.col("__m") > F.col("source_size").cast("double") * HEAVY)
    # s, the number of a source's first row, names the source; r is a row's number in its source
    items = free.select(F.col("__s").alias("s"), (F.col("__g") - F.col("__s")).alias("r"), F.struct(F.col("__g").alias("g"), F.col(size).alias("size"), F.col("__p").alias("p")).alias("i"), "__heavy")
    blocks = aim.agg(F.max("__m").alias("m")).first()["m"] or 1
    done(plain, aim)
    light = items.where("not __heavy")
    # all the light documents of a source have one chance, which the heavy ones move
    whole = light.groupBy("s").agg(F.sum("i.size").alias("size"), F.min("i.p").alias("p"))
    one = F.struct(F.lit(LIGHT).cast("long").alias("g"), F.col("size"), F.col("p"))
    heavy, last = _tree(items.where("__heavy").select("s", "r", _item(F.col("i"))), blocks, seed + 100, whole.select("s", _item(one, 1)))
    moved = last.select(F.col("s").alias("ls"), F.col("i.p").alias("lp"))
    light = light.join(moved, F.col("s") == F.col("ls")).select("s", "r", F.struct(F.col("i.g").alias("g"), F.col("i.size").alias("size"), F.col("lp").alias("p")).alias("i"))
    ones, _ = _tree(light.select("s", "r", _item(F.col("i"))), blocks, seed)
    ones = ones.union(heavy).select(F.col("g").alias("__of"), F.col("one").alias("__one"))
    out = rows.join(ones, F.col("__g") == F.col("__of"), "left")
    lone = (uniform(F.col("__g"), seed=seed) < F.col("__p")).cast("int")
    return back(out.withColumn("copies", F.col("__whole") + F.coalesce("__one", lone)).drop("__g", "__s", "__m", "__x", "__whole", "__p", "__of", "__one"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
