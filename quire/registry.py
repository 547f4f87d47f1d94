"""All operations by name, each as a step from a bundle of relations to another."""

from __future__ import annotations

import importlib.util
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgument, InvalidCommand, MissingArgument
from .operators import content, geometry, info, pages, relations, repair


@dataclass(frozen=True)
class Bundle:
    """Documents as relations; operations return a changed copy. report: what a dump operation has made."""

    relations: Mapping[str, DataFrame]
    report: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.relations:
            raise MissingArgument(f"these documents have no relation {name!r}")
        return self.relations[name]

    def with_(self, **frames: DataFrame) -> Bundle:
        return replace(self, relations={**self.relations, **frames})

    def reported(self, frame: DataFrame) -> Bundle:
        return replace(self, report=frame)


@dataclass(frozen=True)
class Operation:
    name: str
    run: Callable[..., Bundle]
    usage: str
    description: str
    tags: tuple[str, ...] = field(default=())


OPERATIONS: dict[str, Operation] = {}


def operation(name: str, usage: str = "", tags: Sequence[str] = ()):
    """Register a function (bundle, *args) under a name; users may register their own."""

    def put(f: Callable[..., Bundle]) -> Callable[..., Bundle]:
        OPERATIONS[name] = Operation(name, f, usage, (f.__doc__ or "").strip().split("\n")[0], tuple(tags))
        return f

    return put


def _on_pages(name: str, f: Callable[..., DataFrame], usage: str, *, many: bool = True) -> None:
    def run(bundle: Bundle, *args: Any) -> Bundle:
        return bundle.with_(pages=f(bundle["pages"], list(args)) if many else f(bundle["pages"], *args))

    run.__doc__ = f.__doc__
    operation(name, usage, ("pages",))(run)


_on_pages("rotate", pages.rotate, "rotate <specs>")
_on_pages("crop", geometry.crop, "crop <pages(margins|paper)>...")
_on_pages("chop", geometry.chop, "chop <pages>cols|rows<sizes>...")
_on_pages("place", geometry.place, "place <pages(shift=|scale=|spin=)>...")
_on_pages("burst", pages.burst, "burst [pattern]", many=False)
_on_pages("filter", pages.identity, "filter", many=False)
_on_pages("normalize", content.normalize, "normalize [specs]")


@operation("replace", "replace <pages/from/to/count>...", ("pages",))
def _replace(bundle: Bundle, *specs: str) -> Bundle:
    """Regular expressions replaced in normalised content."""
    own = bundle["pages"]
    for spec in specs:
        own = content.replace(own, spec, normalize=True)
    return bundle.with_(pages=own)


#: Relations that refer to pages.
FOLLOWING = ("annots", "dests", "outlines", "fields", "page_labels")


def _moved(bundle: Bundle, change: Callable[[DataFrame], DataFrame], new_document: bool = False) -> Bundle:
    """Pages changed, and what refers to them brought after; pages of sets, by the input that they come from."""
    own = bundle["pages"]
    others = {k: f for k, f in bundle.relations.items() if k in FOLLOWING}
    sets = "set_id" in own.columns
    if not others or (sets and not (new_document and "input_idx" in own.columns)):
        return bundle.with_(pages=change(own))
    out = change(own.withColumn("_src", F.col("page_no")))
    more = [c for c in ("angle", "scale", "width", "height") if c in out.columns] if new_document else []
    more += [F.col("set_id").alias("out_doc"), "input_idx"] if sets else []
    copies = F.col("instance_num") if new_document else F.lit(0)
    chosen = out.filter("_src is not null").select("doc_id", F.col("_src").alias("src_page"), F.col("page_no").alias("out_page"), copies.alias("instance_num"), *more)
    frames = {k: f for k, f in bundle.relations.items() if k not in others} | repair.follow(others, chosen, new_document)
    return replace(bundle, relations={**frames, "pages": out.drop("_src")})


@operation("delete", "delete <specs>", ("pages", "order"))
def _delete(bundle: Bundle, *specs: str) -> Bundle:
    """The pages that no spec selects."""
    return _moved(bundle, lambda own: pages.delete(own, list(specs)))


@operation("cat", "cat [specs]", ("pages", "order"))
def _cat(bundle: Bundle, *specs: str, handles: Mapping[str, object] | None = None) -> Bundle:
    """Ordered concatenation of selections; pages may repeat."""
    own = bundle["pages"]
    by = ("set_id",) if "set_id" in own.columns else ("doc_id",)
    return _moved(bundle, lambda own: pages.cat(own, list(specs) or ["-"], by, handles), True)


@operation("shuffle", "shuffle [specs]", ("pages", "order"))
def _shuffle(bundle: Bundle, *specs: str, handles: Mapping[str, object] | None = None) -> Bundle:
    """One page of each selection in turn."""
    own = bundle["pages"]
    by = ("set_id",) if "set_id" in own.columns else ("doc_id",)
    return _moved(bundle, lambda own: pages.shuffle(own, list(specs) or sorted(handles or {"": 0}), by, handles), True)


@operation("move", "move <source> before|after <target>", ("pages", "order"))
def _move(bundle: Bundle, *args: str) -> Bundle:
    """Pages cut out and put before or after others."""
    if len(args) != 3:
        raise MissingArgument("move <source> before|after <target>")
    return _moved(bundle, lambda own: pages.move(own, *args))


@operation("insert", "insert [N][(paper|w,h|model=spec)] [before|after range]", ("pages", "order"))
def _insert(bundle: Bundle, *args: str) -> Bundle:
    """Blank pages before or after others."""
    import re

    from .functions.dimensions import length, paper

    words = list(args)
    count, size, model = 1, None, None
    if words and (m := re.fullmatch(r"(\d*)(?:\((.*)\))?", words[0])) and (m[2] is not None or (len(words) > 1 and words[1] in ("before", "after"))):
        words.pop(0)
        count = int(m[1] or 1)
        if m[2]:
            if m[2].startswith("model="):
                model = m[2][6:]
            elif "," in m[2]:
                w, h = m[2].split(",")
                size = (length(w, F.col("width")), length(h, F.col("height")))
            else:
                size = paper(m[2])
    where = words.pop(0) if words and words[0] in ("before", "after") else "after"
    return _moved(bundle, lambda own: pages.insert(own, count, where, " ".join(words) or "end", size, model))


def _overlay(name: str) -> None:
    def run(bundle: Bundle, over: DataFrame | Bundle) -> Bundle:
        if isinstance(over, Bundle):
            own = over["pages"]
            if own.select("doc_id").distinct().limit(2).count() > 1:
                raise InvalidArgument("an overlay is one document")
            over = own.select(F.col("page_no").alias("over_page"), (F.col("x1") - F.col("x0")).alias("ow"), (F.col("y1") - F.col("y0")).alias("oh"))
        return bundle.with_(overlays=geometry.overlay(bundle["pages"], over, "multi" in name, "stamp" in name))

    run.__doc__ = "Layout of another document's pages over or under these."
    operation(name, f"{name} <overlay>", ("overlay",))(run)


for _name in ("stamp", "multistamp", "background", "multibackground"):
    _overlay(_name)


@operation("add_text", "add_text <pages>/<text>/(options)...", ("content",))
def _add_text(bundle: Bundle, *rules: str | tuple[str, str, str]) -> Bundle:
    """Templated texts at places of pages."""
    return bundle.with_(texts=content.add_text(bundle["pages"], rules, styled=any(isinstance(r, str) for r in rules)))


@operation("inject", "inject <pages> head|tail <code>...", ("content",))
def _inject(bundle: Bundle, *args: str) -> Bundle:
    """Code before or after the content of pages."""
    rules, specs = [], []
    words = list(args)
    while words:
        w = words.pop(0)
        if w in ("head", "tail"):
            if not words:
                raise MissingArgument(f"code after {w}")
            rules.append((",".join(specs) or "-", w, words.pop(0)))
            specs = []
        else:
            specs.append(w)
    if specs:
        raise InvalidArgument(f"specs without head or tail: {specs}")
    return bundle.with_(pages=content.inject(bundle["pages"], rules))


def _dump_data(name: str, escape: bool) -> None:
    def run(bundle: Bundle, *args: str) -> Bundle:
        get = bundle.relations.get
        if args == ("json",):
            return bundle.reported(info.dump_whole_json(get("docinfo"), get("pages"), get("outlines"), get("page_labels"), get("documents")))
        return bundle.reported(info.dump_data(get("docinfo"), get("pages"), get("outlines"), get("page_labels"), escape, get("documents"), args == ("extra",)))

    run.__doc__ = "Metadata as stanza lines, or as JSON."
    operation(name, f"{name} [json]", ("info",))(run)


def _update_info(name: str, decode: bool) -> None:
    def run(bundle: Bundle, lines: DataFrame | Bundle) -> Bundle:
        lines = lines["lines"] if isinstance(lines, Bundle) else lines
        totals = bundle["pages"].groupBy("doc_id").agg(F.max("page_no").alias("n_pages")) if "pages" in bundle.relations else None
        new = info.updates(info.read_stanzas(lines, decode), totals)
        frames = dict(bundle.relations)
        if "docinfo" in frames:
            frames["docinfo"] = info.update_docinfo(frames["docinfo"], new["docinfo"])
        for name in ("outlines", "page_labels"):
            if name in frames:
                frames[name] = info.replace_all(frames[name], new[name])
        if "pages" in frames:
            frames["pages"] = info.set_media(frames["pages"], new["page_media"])
        if "documents" in frames and "id0" in frames["documents"].columns:
            ids = new["ids"].withColumnRenamed("id0", "_id0")
            frames["documents"] = frames["documents"].join(ids, "doc_id", "left").withColumn("id0", F.coalesce("_id0", "id0")).drop("_id0")
        return replace(bundle, relations=frames)

    run.__doc__ = "Metadata from stanza lines."
    operation(name, f"{name} <lines>", ("info",))(run)


def _report(name: str, make: Callable[[Bundle], DataFrame], description: str) -> None:
    def run(bundle: Bundle, *_: str) -> Bundle:
        return bundle.reported(make(bundle))

    run.__doc__ = description
    operation(name, name, ("report",))(run)


for _suffix, _plain in (("", True), ("_utf8", False)):
    _dump_data(f"dump_data{_suffix}", _plain)
    _update_info(f"update_info{_suffix}", _plain)
    _report(f"dump_data_fields{_suffix}", lambda b, escape=_plain: relations.dump_data_fields(b["fields"], escape), "Form fields as stanzas.")
_report("generate_fdf", lambda b: relations.generate_fdf(b["fields"]), "Field values as FDF.")
_report("dump_annots", lambda b: relations.dump_annots(b["annots"], b.relations.get("dests")), "Annotations as JSON records.")
_report("dump_data_annots", lambda b: relations.dump_data_annots(b["annots"], b.relations.get("pages"), b.relations.get("documents")), "Annotations as report lines.")
_report("dump_dests", lambda b: relations.dump_dests(b["dests"]), "Named destinations.")
_report("dump_layers", lambda b: relations.dump_layers(b["layers"], b["layer_off"]), "Layers and their default states.")
_report("dump_text", lambda b: content.dump_text(b["pages"]), "Text of all pages.")
_report("dump_files", lambda b: relations.dump_files(b["attachments"]), "Attachments and their sizes.")
_report("render", lambda b: relations.render(b["pages"]), "Names and pixel sizes of page images.")
_report("dump_signatures", lambda b: relations.dump_signatures(b), "Validation of signatures.")
_report("optimize_images", lambda b: relations.optimize_images(b), "Recompressed images.")


@operation("fill_form", "fill_form <values>", ("forms",))
def _fill_form(bundle: Bundle, values: DataFrame | Bundle) -> Bundle:
    """Field values by fully qualified name."""
    if isinstance(values, Bundle):
        from .sources.bundles import fdf_values, xfdf_values

        own = values.relations
        values = fdf_values(own["fdf"]) if "fdf" in own else xfdf_values(own["xfdf"]) if "xfdf" in own else values["values"]
    return bundle.with_(fields=relations.fill_form(bundle["fields"], values))


@operation("modify_annots", "modify_annots <selector(Key=Value,...)>...", ("annotations",))
def _modify_annots(bundle: Bundle, *rules: str) -> Bundle:
    """Keys of annotations set or deleted."""
    return bundle.with_(annots=relations.modify_annots(bundle["annots"], rules, bundle["pages"]))


@operation("delete_annots", "delete_annots [specs]", ("annotations",))
def _delete_annots(bundle: Bundle, specs: str = "-") -> Bundle:
    """No annotations on the selected pages."""
    return bundle.with_(annots=relations.delete_annots(bundle["annots"], specs, bundle["pages"]))


@operation("attach_files", "attach_files <files> [to_page spec] [relation T]", ("attachments",))
def _attach_files(bundle: Bundle, *args: str) -> Bundle:
    """Attachments of documents or pages; a keyword is for all files before it that don't have it yet."""
    files: list[list] = []
    words = list(args)
    while words:
        w = words.pop(0)
        if w in ("to_page", "relation"):
            if not words:
                raise MissingArgument(f"a value after {w}")
            at, value = (1 if w == "to_page" else 2), words.pop(0)
            for f in files:
                f[at] = value if f[at] is None else f[at]
        else:
            files.append([w, None, None])
    return bundle.with_(attached=relations.attach_files(bundle["pages"], [tuple(f) for f in files]))


@operation("unpack_files", "unpack_files <folder>", ("attachments",))
def _unpack_files(bundle: Bundle, path: str) -> Bundle:
    """Attachments written to a folder."""
    from .sources.bundles import bucketed

    bucketed(relations.unpack_files(bundle["attachments"]), path, "doc_id", "name")
    return bundle


def call(name: str, bundle: Bundle, *args: Any, **kw: Any) -> Bundle:
    if name not in OPERATIONS:
        raise InvalidCommand(f"no such operation: {name!r}")
    return OPERATIONS[name].run(bundle, *args, **kw)


def catalog(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    return spark.createDataFrame([(o.name, o.usage, o.description, list(o.tags)) for o in OPERATIONS.values()], "name string, usage string, description string, tags array<string>")


def help_text(topic: str = "") -> str:
    """All operations, those of `tag:t`, or one."""
    if topic in OPERATIONS:
        o = OPERATIONS[topic]
        return f"{o.usage}\n{o.description}"
    tag = topic.removeprefix("tag:") if topic.startswith("tag:") else None
    return "\n".join(f"{o.usage}: {o.description}" for o in OPERATIONS.values() if tag is None or tag in o.tags)


def load_user_operations(folder: str | Path) -> list[str]:
    """Import every *.py of a folder, which may register operations; what fails is logged."""
    done = []
    for p in sorted(Path(folder).glob("*.py")):
        try:
            spec = importlib.util.spec_from_file_location(f"quire_user_{p.stem}", p)
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
            done.append(p.stem)
        except Exception:
            logging.getLogger(__name__).exception("user operation %s", p)
    return done
