"""Page order: concatenate, interleave, split, delete, move, insert, rotate, scale.

Pages are rows with doc_id and page_no (from 1, without gaps). Every operator
numbers its result anew; all windows are by document, so one exchange on doc_id
serves a chain of operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..errors import InvalidArgument, MissingArgument
from ..pagespec import PageSpec, any_match, fold, parse


#: Ranges of documents that burst sums up apart.
RANGES = 256

#: Bytes of files behind the rows of one task, where documents are dealt over tasks.
SHARE = 4 << 20

#: SHAREs that a task reads at most.
READ = 4

#: What a selection says of its pages; a further selection says it anew.
LINEAGE = ("src_page", "instance_num", "angle", "is_relative", "scale")


def dealt(rows: DataFrame, *by: str, times: int = 1) -> DataFrame:
    """rows dealt by key over as many tasks as the files behind them have SHAREs, so that a task's windows don't grow with the input.

    Left to itself Spark merges the parts of an exchange up to so many compressed bytes, which may be millions of rows.
    A task that deals to more than 200 others keeps its rows in memory; what it has read is kept small by in_shares.
    times: how many rows a row that is read becomes. Rows that have been dealt already, that no file stands behind, or
    that are no more than a share for each core stay as they are.
    """
    plan = rows._jdf.queryExecution().analyzed()
    if "RepartitionByExpression" in plan.toString():
        return rows
    leaves = plan.collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in files if x.getClass().getSimpleName() == "LogicalRelation")
    n = -(-size * times // SHARE)
    return rows.repartition(n, *by) if n > rows.sparkSession.sparkContext.defaultParallelism else rows


def in_shares(table: DataFrame) -> DataFrame:
    """A table as the reader gives it, of which a task reads READ SHAREs at most, or a row group that is larger.

    Spark has a setting of sessions for this and no option of readers; it counts as it is in the session that a relation
    was read in. So the relation gets a copy of the session with the setting; the frame stays in the caller's.
    """
    spark, found = table.sparkSession, table._jdf.queryExecution().analyzed()
    if found.getClass().getSimpleName() != "LogicalRelation" or found.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return table
    session, own = spark._jsparkSession.cloneSession(), found.relation()
    if session.sessionState().conf().filesMaxPartitionBytes() <= READ * SHARE:
        return table
    session.conf().set("spark.sql.files.maxPartitionBytes", str(READ * SHARE))
    own = own.copy(own.location(), own.partitionSchema(), own.dataSchema(), own.bucketSpec(), own.fileFormat(), own.options(), session)
    return DataFrame(spark._jsparkSession.baseRelationToDataFrame(own), spark)


def with_total(pages: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """pages and n_pages, the number of pages of the document."""
    return pages if "n_pages" in pages.columns else dealt(pages, *by).withColumn("n_pages", F.count(F.lit(1)).over(Window.partitionBy(*by)).cast("int"))


def renumber(pages: DataFrame, *order: Column | str, by: Sequence[str] = ("doc_id",), name: str = "page_no") -> DataFrame:
    return pages.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _specs(specs: str | Sequence[str] | Sequence[PageSpec], handles=None) -> list[PageSpec]:
    if isinstance(specs, str):
        return parse(specs, handles)
    return [s for x in specs for s in ([x] if isinstance(x, PageSpec) else parse(x, handles))]


def plan(documents: DataFrame, specs: Sequence[PageSpec], by: Sequence[str] = ("doc_id",), interleave: bool = False, strict: bool = True) -> DataFrame:
    """The ordered selection: by, doc_id, src_page, out_page, instance_num, angle, is_relative, scale.

    documents: by, doc_id, n_pages and, where specs name inputs, handle. Nothing but
    the number of pages is read; a page that is taken twice has two rows.
    """

    def part(i: int, s: PageSpec) -> Column:
        angle, relative = s.rotate or (0, True)
        rows = F.transform(
            s.sequence_column(F.col("n_pages"), strict),
            lambda p, k: F.struct(F.lit(i).alias("spec_idx"), (k + 0).alias("pos"), p.alias("src_page"), F.lit(angle).alias("angle"), F.lit(relative).alias("is_relative"), F.lit(s.scale).alias("scale")),
        )
        return rows if s.handle is None else F.when(F.col("handle") == s.handle, rows)

    chosen = F.flatten(F.array_compact(F.array(*(part(i, s) for i, s in enumerate(specs)))))
    keys = _keys(documents, by)
    out = documents.select(*keys, F.inline(chosen))
    order = ("pos", "spec_idx") if interleave else ("spec_idx", "pos")
    out = renumber(out, *order, *keys, by=by, name="out_page")
    copies = Window.partitionBy(*keys, "src_page").orderBy("out_page")
    return out.withColumn("instance_num", (F.row_number().over(copies) - 1).cast("int")).drop("spec_idx", "pos")


def _keys(frame: DataFrame, by: Sequence[str]) -> list[str]:
    """What tells documents apart: the set, the document, and the input that it comes from."""
    return [*dict.fromkeys([*by, "doc_id"]), *(["handle"] if "handle" in frame.columns else [])]


def documents_of(pages: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    return pages.groupBy(*_keys(pages, by)).agg(F.max("page_no").cast("int").alias("n_pages"))


def _select(pages: DataFrame, specs: Sequence[PageSpec], by: Sequence[str], interleave: bool, strict: bool) -> DataFrame:
    """Pages with a row for each time that they are taken, in one exchange.

    A page knows from its number and the document's total which specs take it, and its
    place among a spec's pages is its number, counted up or down. So no plan is joined
    back: rows are exploded where they are, and all windows are by the set.
    """
    pages = pages.drop(*LINEAGE)
    keys = _keys(pages, by)
    if list(by) != keys:
        pages = pages.repartition(*by)  # the documents of a set together, for the windows of both
    pages = with_total(pages, keys)
    page, total = F.col("page_no"), F.col("n_pages")

    def part(i: int, s: PageSpec) -> Column:
        a, b = s.start.column(total), s.end.column(total)
        fits = a.between(1, total) & b.between(1, total)
        angle, relative = s.rotate or (0, True)
        row = F.struct(F.lit(i).alias("spec_idx"), F.when(a <= b, page).otherwise(-page).alias("pos"), F.lit(angle).alias("angle"), F.lit(relative).alias("is_relative"), F.lit(s.scale).alias("scale"))
        hit = fits & s.match_column(page, total)
        if strict:
            hit = F.when(fits, s.match_column(page, total)).otherwise(F.raise_error(F.concat(F.lit(f"{s.text!r} selects a page out of range 1-"), total.cast("string"))).cast("boolean"))
        if s.handle is not None:
            return F.when(F.col("handle") == s.handle, F.when(hit, row))
        return F.when(hit, row)

    taken = F.array_compact(F.array(*(part(i, s) for i, s in enumerate(specs))))
    out = pages.select(*(c for c in pages.columns if c != "n_pages"), F.inline(taken)).withColumnRenamed("page_no", "src_page")
    others = [k for k in keys if k not in by]
    if interleave:
        out = renumber(out, "pos", *others, by=[*by, "spec_idx"], name="pos")
        out = renumber(out, "pos", "spec_idx", by=by)
    else:
        # of one spec, the documents of a set follow each other page by page, as in a plan
        out = renumber(out, "spec_idx", "pos", *others, by=by)
    copies = Window.partitionBy(*by, *others, "src_page").orderBy("page_no")
    out = out.withColumn("instance_num", (F.row_number().over(copies) - 1).cast("int")).drop("spec_idx", "pos")
    if "rotation" in out.columns:
        out = out.withColumn("rotation", F.pmod(F.when(F.col("is_relative"), F.col("rotation") + F.col("angle")).otherwise(F.col("angle")), F.lit(360)))
    for c in ("width", "height", "x0", "y0", "x1", "y1"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c) * F.col("scale"))
    return out


def cat(pages: DataFrame, specs: str | Sequence[str] = ("",), by: Sequence[str] = ("doc_id",), handles=None, strict: bool = True) -> DataFrame:
    """Ordered concatenation; pages may repeat. Adds src_page, instance_num, angle, is_relative and scale."""
    return _select(pages, _specs(specs, handles), by, False, strict)


def shuffle(pages: DataFrame, specs: str | Sequence[str], by: Sequence[str] = ("doc_id",), handles=None, strict: bool = True) -> DataFrame:
    """One page of every spec in turn, passing over specs that have run out."""
    return _select(pages, _specs(specs, handles), by, True, strict)


def burst(pages: DataFrame, pattern: str = "pg_%04d.pdf") -> DataFrame:
    """One document for each page, named by a counter over all documents in order of doc_id.

    The counter adds a document's offset to its page number. Offsets are sums over
    documents in order, by ranges of them, so no page takes part in a global sort.
    """
    if "%" not in pattern:
        raise InvalidArgument(f"the pattern must have a %: {pattern!r}")
    sizes = pages.groupBy("doc_id").agg(F.max("page_no").cast("long").alias("n"))
    part = F.lit(0)
    # bounds are values of the driver, so that every task deals documents out alike
    if isinstance(pages.schema["doc_id"].dataType, NumericType):
        bounds = sizes.agg(F.percentile_approx("doc_id", [k / RANGES for k in range(1, RANGES)], 10_000).alias("b")).first()["b"] or []
    else:
        # about RANGES ids that their hashes choose
        n = sizes.count()
        bounds = [r["doc_id"] for r in sizes.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(n // RANGES, 1))) == 0).select("doc_id").limit(4 * RANGES).collect()]
    if bounds:
        part = F.size(F.filter(F.array(*(F.lit(x) for x in sorted({x for x in bounds if x is not None}))), lambda x: x < F.col("doc_id")))
    parts = sizes.withColumn("part", part)
    before = parts.groupBy("part").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("within", within).join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("within")).alias("offset"))
    out = pages.join(offsets, "doc_id").withColumn("counter", F.col("offset") + F.col("page_no")).drop("offset")
    return out.withColumn("file_name", F.format_string(pattern, "counter"))


def delete(pages: DataFrame, specs: str | Sequence[str]) -> DataFrame:
    """The pages that no spec selects."""
    pages = with_total(pages)
    return renumber(pages.filter(~any_match(_specs(specs), F.col("page_no"), F.col("n_pages"))).drop("n_pages"), "page_no")


def move(pages: DataFrame, source: str, where: str, target: str) -> DataFrame:
    """The source pages, before the first or after the last target page; without source pages nothing moves."""
    if where not in ("before", "after"):
        raise InvalidArgument(f"before or after, not {where!r}")
    pages = with_total(pages)
    page, total, by = F.col("page_no"), F.col("n_pages"), Window.partitionBy("doc_id")
    aim = F.when(any_match(_specs(target), page, total), page)
    anchor = F.min(aim).over(by) if where == "before" else F.max(aim).over(by) + 1
    out = pages.withColumn("src", any_match(_specs(source), page, total)).withColumn("anchor", anchor)
    out = out.withColumn("anchor", F.when(F.col("anchor").isNull() & F.max("src").over(by), F.raise_error(F.lit(f"{target!r} selects no page")).cast("int")).otherwise(F.col("anchor")))
    rank = F.when(F.col("src"), 1).when(page < F.col("anchor"), 0).otherwise(2)
    out = out.withColumn("rank", F.when(F.col("anchor").isNull(), 0).otherwise(rank))
    return renumber(out, "rank", page).drop("src", "anchor", "rank", "n_pages")


def insert(pages: DataFrame, count: int, where: str, target: str, size: tuple[Column | float, Column | float] | None = None, model: str | None = None) -> DataFrame:
    """count blank pages before or after each target page; adds is_blank.

    Their width and height are size, those of the model pages in turn, or those of
    the target page; other columns of a blank page are null.
    """
    if count < 1:
        raise InvalidArgument("at least one page must be inserted")
    pages = with_total(pages)
    page, total = F.col("page_no"), F.col("n_pages")
    boxed = [c for c in ("width", "height") if c in pages.columns]
    targets = pages.filter(any_match(_specs(target), page, total))
    keys = targets.select("doc_id", page.alias("at"), *boxed)
    if model and boxed:
        # the model pages, in turn: a document's list of them travels with its pages
        hit = any_match(_specs(model), page, total)
        listed = F.sort_array(F.collect_list(F.when(hit, F.struct(page.alias("p"), *boxed))).over(Window.partitionBy("doc_id")))
        chosen = pages.withColumn("_models", listed).filter(any_match(_specs(target), page, total))
        at = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")) - 1) % F.size("_models")
        none = F.raise_error(F.lit(f"{model!r} selects no page")).cast("int")
        chosen = chosen.withColumn("_m", F.get("_models", F.when(F.size("_models") == 0, none).otherwise(at)))
        keys = chosen.select("doc_id", page.alias("at"), *(F.col(f"_m.{c}").alias(c) for c in boxed))
    elif size and boxed:
        keys = keys.withColumn("width", size[0] if isinstance(size[0], Column) else F.lit(float(size[0]))).withColumn("height", size[1] if isinstance(size[1], Column) else F.lit(float(size[1])))
    blank = keys.select("doc_id", "at", *boxed, F.explode(F.sequence(F.lit(1), F.lit(count))).alias("copy"))
    blank = blank.withColumn("side", F.lit(0 if where == "before" else 2)).withColumn("is_blank", F.lit(True))
    base = pages.drop("n_pages").withColumn("at", page).withColumn("side", F.lit(1)).withColumn("copy", F.lit(0)).withColumn("is_blank", F.lit(False))
    out = base.unionByName(blank, allowMissingColumns=True)
    return renumber(out, "at", "side", "copy").drop("at", "side", "copy")


def rotate(pages: DataFrame, specs: str | Sequence[str]) -> DataFrame:
    """Rotation and scale of the selected pages; specs act one after the other."""
    pages = with_total(pages)
    own, page, total = _specs(specs), F.col("page_no"), F.col("n_pages")

    def turn(now: Column, s: PageSpec) -> Column:
        return now if s.rotate is None else (F.pmod(now + s.rotate[0], F.lit(360)) if s.rotate[1] else F.lit(s.rotate[0]))

    out = pages.withColumn("rotation", fold(own, F.col("rotation"), turn, page, total).cast("int"))
    for c in ("width", "height", "x0", "y0", "x1", "y1"):
        if c in pages.columns:
            out = out.withColumn(c, fold(own, F.col(c), lambda now, s: now * s.scale if s.scale != 1 else now, page, total))
    return out.drop("n_pages")


def identity(pages: DataFrame) -> DataFrame:
    """The operation when none is given."""
    return pages


def select_first(pages: DataFrame, n: int) -> DataFrame:
    """The first n pages of each document: page numbers are positions, so no sort is needed."""
    if n < 0:
        raise MissingArgument("a number of pages")
    return pages.filter(F.col("page_no") <= n)
