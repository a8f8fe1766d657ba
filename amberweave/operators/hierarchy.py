"""Pages to books to volumes to shelves: fixed runs, medoids, centroid prototypes, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import set_id
from ..functions.vectors import cosine, dot, doubles, norm

#: Members of a book, a volume and a shelf.
BOOK, VOLUME, SHELF = 8, 4, 4
#: Cap of the adjacency list, least fan-out of a split.
ADJACENT_CAP, MIN_FANOUT = 16, 4


def runs(df: DataFrame, by: list[str], order: str, size: int, name: str) -> DataFrame:
    """Number the rows of each ``by`` in order and cut them into runs of ``size``: adds pos and the run's number."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("pos", F.row_number().over(w) - 1).withColumn(name, F.floor(F.col("pos") / size).cast("int"))


def _mean(vectors: Column) -> Column:
    """Element mean of an array of vectors of one length."""
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.lit(0), F.size(vectors) - 1)), F.get(vectors, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(vectors))


def _bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, though lambdas name it often."""
    return F.transform(F.array(value), use)[0]


def _medoid(members: Column) -> Column:
    """Member (pos, page_id, v) of least total cosine distance to the others, first of equals."""
    unit = lambda v: _bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    units = F.transform(members, lambda m: F.struct(m["pos"].alias("pos"), m["page_id"].alias("page_id"), m["v"].alias("v"), unit(m["v"]).alias("u")))

    def best(us: Column) -> Column:
        mean = _mean(F.transform(us, lambda m: m["u"]))
        far = lambda s: F.transform(us, lambda m: F.struct(F.round(F.size(us) * (1 - dot(m["u"], s)), 9).alias("d"), m["pos"].alias("pos"), m["page_id"].alias("page_id"), m["v"].alias("v")))
        return F.array_min(_bound(mean, far))

    return _bound(units, best)


def books(pages: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """(doc, book_no, book_id, page_ids, medoid_page_id, medoid_v): runs of eight pages in document order.

    Books, volumes and shelves of a document come from one shuffle by document: a run is a bounded
    array, so its medoid or mean is worked out in its row.
    """
    own = runs(pages, [doc], order, BOOK, "book_no")
    rows = own.groupBy(doc, "book_no").agg(F.array_sort(F.collect_list(F.struct("pos", "page_id", doubles(F.col("v")).alias("v")))).alias("m"))  # at most eight
    rows = rows.select(doc, "book_no", F.transform("m", lambda x: x["page_id"]).alias("page_ids"), _medoid(F.col("m")).alias("best"))
    return rows.select(doc, "book_no", "page_ids", F.col("best.page_id").alias("medoid_page_id"), F.col("best.v").alias("medoid_v"), set_id(F.col("page_ids")).alias("book_id"))


def adjacency(pages: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """(page_id, neighbor_id, similarity): the page before and after, within a book."""
    own = runs(pages, [doc], order, BOOK, "book_no")
    w = Window.partitionBy(doc, "book_no").orderBy("pos")
    pair = own.withColumn("n_id", F.lead("page_id").over(w)).withColumn("n_v", F.lead("v").over(w)).where("n_id is not null")
    pair = pair.withColumn("similarity", F.round(cosine(doubles(F.col("v")), doubles(F.col("n_v"))), 6))
    there = pair.select("page_id", F.col("n_id").alias("neighbor_id"), "similarity")
    return there.unionByName(there.select(F.col("neighbor_id").alias("page_id"), F.col("page_id").alias("neighbor_id"), "similarity"))


def volumes(book_rows: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, volume_no, volume_id, book_ids, prototype, variance): runs of four books.

    The prototype is the mean of the books' medoid vectors; the variance the mean squared cosine distance to it.
    """
    own = book_rows.withColumn("volume_no", F.floor(F.col("book_no") / VOLUME).cast("int"))
    rows = own.groupBy(doc, "volume_no").agg(F.array_sort(F.collect_list(F.struct("book_no", "book_id", "medoid_v"))).alias("m"))  # at most four

    def spread(mean: Column) -> Column:
        far = F.transform("m", lambda x: F.pow(1 - cosine(x["medoid_v"], mean), 2))
        return F.struct(mean.alias("prototype"), (F.aggregate(far, F.lit(0.0), lambda s, x: s + x) / F.size("m")).alias("variance"))

    rows = rows.select(doc, "volume_no", F.transform("m", lambda x: x["book_id"]).alias("book_ids"), _bound(_mean(F.transform("m", lambda x: x["medoid_v"])), spread).alias("p"))
    return rows.select(doc, "volume_no", "book_ids", "p.prototype", "p.variance", set_id(F.col("book_ids")).alias("volume_id"))


def shelves(volume_rows: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, shelf_no, shelf_id, volume_ids, prototype): runs of four volumes and the mean of their prototypes."""
    own = volume_rows.withColumn("shelf_no", F.floor(F.col("volume_no") / SHELF).cast("int"))
    rows = own.groupBy(doc, "shelf_no").agg(F.array_sort(F.collect_list(F.struct("volume_no", "volume_id", "prototype"))).alias("m"))
    rows = rows.select(doc, "shelf_no", F.transform("m", lambda x: x["volume_id"]).alias("volume_ids"), _mean(F.transform("m", lambda x: x["prototype"])).alias("prototype"))
    return rows.withColumn("shelf_id", set_id(F.col("volume_ids")))


def split_wide(parents: DataFrame, ident: str, children: str, limit: int, salt: str, keep_first: bool = False) -> DataFrame:
    """Parents over the fan-out limit, cut into runs of ``limit`` children.

    A run's id is the salted digest of its sorted children; with ``keep_first`` the first run keeps the
    parent's id. Parents within the limit stay as they are.
    """
    limit = max(MIN_FANOUT, limit)
    wide = F.size(children) > limit
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(children) - 1) / limit).cast("int")), lambda i: F.struct(i.alias("part"), F.slice(children, i * limit + 1, F.lit(limit)).alias("ids")))
    one = F.array(F.struct(F.lit(0).alias("part"), F.col(children).alias("ids")))
    rows = parents.select(F.col(ident).alias("parent_id"), wide.alias("wide"), F.explode(F.when(wide, cut).otherwise(one)).alias("p"))
    own = ~F.col("wide") | (F.lit(keep_first) & (F.col("p.part") == 0))
    return rows.select("parent_id", F.col("p.part").alias("part"), F.when(own, F.col("parent_id")).otherwise(set_id(F.col("p.ids"), salt)).alias(ident), F.col("p.ids").alias(children))
