"""Command lines of several stages: `A=one B=two cat A1-3 B --- rotate right --- output x`.

Stages are parsed before anything is read. Identity stages are dropped, and deletes
of one stage each stay apart, because the second counts pages after the first.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateArgument, InvalidCommand, MissingArgument
from ..registry import FOLLOWING, OPERATIONS, Bundle, call
from ..sources.bundles import file_arguments

#: Operations whose words name inputs, and options that count in the last stage only.
OPERANDS = ("stamp", "multistamp", "background", "multibackground", "fill_form", "update_info", "update_info_utf8")
IDS = ("keep_first_id", "keep_final_id")

#: Options by the number of values that follow; -1: any number. Fixed names.
OPTIONS = {
    "output": 1, "owner_pw": 1, "user_pw": 1, "encrypt_40bit": 0, "encrypt_128bit": 0, "encrypt_aes128": 0, "encrypt_aes256": 0, "no_encrypt_metadata": 0, "allow": -1,
    "compress": 0, "uncompress": 0, "linearize": 0, "drop_info": 0, "drop_xmp": 0, "drop_xfa": 0, "keep_first_id": 0, "keep_final_id": 0, "need_appearances": 0, "flatten": 0,
    "sign_key": 1, "sign_cert": 1, "sign_field": 1, "sign_pass_env": 1, "sign_pass_prompt": 0, "verbose": 0,
}

#: Permissions that `allow` takes, and what each grants. Fixed values.
PERMISSIONS = {
    "Printing": ["print_highres"],
    "DegradedPrinting": ["print_lowres"],
    "ModifyContents": ["modify_other", "modify_assembly"],
    "Assembly": ["modify_assembly"],
    "CopyContents": ["extract", "accessibility"],
    "ScreenReaders": ["accessibility"],
    "ModifyAnnotations": ["modify_annotation"],
    "FillIn": ["modify_form"],
    "AllFeatures": ["all"],
}


@dataclass
class Stage:
    operation: str
    inputs: list[str] = field(default_factory=list)
    handles: dict[str, str] = field(default_factory=dict)
    passwords: dict[str, str] = field(default_factory=dict)
    args: list[str] = field(default_factory=list)
    options: dict[str, Any] = field(default_factory=dict)


def parse(argv: Sequence[str]) -> list[Stage]:
    parts: list[list[str]] = [[]]
    for a in argv:
        if a == "---":
            parts.append([])
        else:
            parts[-1].append(a)
    if any(not p for p in parts):
        raise InvalidCommand("an empty stage")
    return [_stage(p, i == 0) for i, p in enumerate(parts)]


def _stage(words: Sequence[str], first: bool) -> Stage:
    at = next((i for i, w in enumerate(words) if w.lower() in OPERATIONS), None)
    before = words[:at] if at is not None else []
    rest = list(words[at + 1 :]) if at is not None else list(words)
    out = Stage(words[at].lower() if at is not None else "filter")
    if at is None:
        cut = next((i for i, w in enumerate(rest) if w.lower() in OPTIONS), len(rest))
        before, rest = rest[:cut], rest[cut:]
    given: list[str] = []
    if "input_pw" in before:
        i = list(before).index("input_pw")
        before, given = before[:i], list(before[i + 1 :])
        if not given:
            raise MissingArgument("a password after input_pw")
    for w in before:
        handle, eq, name = w.partition("=")
        if eq and re.fullmatch(r"[A-Za-z]", handle):
            out.handles[handle.upper()] = name
            out.inputs.append(name)
        else:
            out.inputs.append(w)
    if not first and not {"_", "-"} & set(out.inputs):
        out.inputs.insert(0, "_")  # what the stage before has made comes first
    by_place = []
    for g in given:  # by handle, then by place
        handle, eq, word = g.partition("=")
        if eq and handle.upper() in out.handles:
            out.passwords[out.handles[handle.upper()]] = word
        else:
            by_place.append(g)
    left = [n for n in out.inputs if n not in out.passwords]
    if len(by_place) > len(left):
        raise InvalidCommand("more passwords than inputs")
    out.passwords |= dict(zip(left, by_place, strict=False))
    if at is None and len(out.inputs) > 1:
        out.operation = "cat"
    start = next((i for i, w in enumerate(rest) if w.lower() in OPTIONS), len(rest))
    out.args, options = rest[:start], rest[start:]
    while options:
        name = options.pop(0).lower()
        if name not in OPTIONS:
            raise InvalidCommand(f"{name!r} can't follow an option")
        if name in out.options and OPTIONS[name] == 1:
            raise DuplicateArgument(f"{name} is given twice")
        if OPTIONS[name] == 1:
            if not options:
                raise MissingArgument(f"a value after {name}")
            out.options[name] = options.pop(0)
        elif OPTIONS[name] == -1:
            values = []
            while options and options[0].lower() not in OPTIONS:
                values.append(options.pop(0))
            out.options[name] = [*out.options.get(name, ()), *values]
        else:
            out.options[name] = True
    return out


def encryption(options: Mapping[str, Any]) -> dict[str, Any] | None:
    """The method and permissions that the options ask for; None without encryption. Nothing is encrypted here."""
    methods = [m for m in ("encrypt_40bit", "encrypt_128bit", "encrypt_aes128", "encrypt_aes256") if options.get(m)]
    if len(methods) > 1:
        raise InvalidCommand(f"one method of encryption, not {methods}")
    if not methods and not (options.get("owner_pw") or options.get("user_pw")):
        return None
    method = methods[0] if methods else "encrypt_aes128"
    if options.get("no_encrypt_metadata") and "aes" not in method:
        raise InvalidCommand("no_encrypt_metadata needs AES")
    known = {k.lower(): k for k in PERMISSIONS}
    wrong = [a for a in options.get("allow", ()) if a.lower() not in known]
    if wrong:
        raise InvalidCommand(f"no such permissions: {wrong}")
    names = [known[a.lower()] for a in options.get("allow", ())] or ["AllFeatures"]
    return {"method": method, "permissions": sorted({p for n in names for p in PERMISSIONS[n]}), "metadata": not options.get("no_encrypt_metadata", False)}


def with_options(bundle: Bundle, options: Mapping[str, Any]) -> Bundle:
    """Options that change relations: metadata dropped, forms and annotations flattened."""
    frames = dict(bundle.relations)
    if options.get("drop_info") and "docinfo" in frames:
        frames["docinfo"] = frames["docinfo"].limit(0)
    for option, column in (("drop_xmp", "xmp"), ("drop_xfa", "xfa")):
        if options.get(option) and "documents" in frames and column in frames["documents"].columns:
            frames["documents"] = frames["documents"].withColumn(column, F.lit(None).cast("string"))
    plan = encryption(options)
    if plan is not None and frames:
        spark = next(iter(frames.values())).sparkSession
        frames["encryption_plan"] = spark.createDataFrame([(plan["method"], plan["permissions"], plan["metadata"])], "method string, permissions array<string>, metadata boolean")
    for option, pick in (("keep_first_id", F.min_by), ("keep_final_id", F.max_by)):
        if options.get(option) and "documents" in frames and {"input_idx", "id0"} <= set(frames["documents"].columns):
            own = frames["documents"]
            key = "set_id" if "set_id" in own.columns else "doc_id"
            frames["output_ids"] = own.groupBy(key).agg(pick("id0", "input_idx").alias("id0"))
    if options.get("flatten"):
        frames.pop("annots", None)
        frames.pop("fields", None)
    if options.get("need_appearances") and "fields" not in frames:
        logging.getLogger("quire").warning("need_appearances: these documents have no form")
    if options.get("need_appearances") and "documents" in frames:
        frames["documents"] = frames["documents"].withColumn("need_appearances", F.lit(True))
    if options.get("sign_key") is not None or options.get("sign_cert") is not None:
        if options.get("sign_key") is None or options.get("sign_cert") is None:
            raise MissingArgument("a key and a certificate")
        from ..errors import Requires

        raise Requires("sign", "a signing library")
    return Bundle(frames, bundle.report)


def writer_options(options: Mapping[str, Any]) -> dict[str, Any]:
    """How a bundle is to be written: compress and uncompress choose the codec, linearize puts pages in order; both codecs are an error."""
    if options.get("compress") and options.get("uncompress"):
        raise InvalidCommand("compress or uncompress, not both")
    out: dict[str, Any] = {}
    if options.get("compress") or options.get("uncompress"):
        out["compression"] = "zstd" if options.get("compress") else "none"
    if options.get("linearize"):
        out["ordered"] = True
    return out


def run(stages: Sequence[Stage], inputs: Mapping[str, Bundle], sink=None) -> Bundle:
    """Run parsed stages over named bundles; sink(bundle, path, **writer_options) writes where a stage has an output.

    Words of fill_form, update_info and overlays that name an input stand for it. Ids are kept as the last stage says.
    """
    now: Bundle | None = None
    last = {k: v for k, v in stages[-1].options.items() if k in IDS} if stages else {}
    for i, s in enumerate(stages):
        names = s.inputs or (["_"] if i else [])
        given = [now if n == "_" else inputs.get(n) for n in names]
        if not given or any(g is None for g in given):
            raise MissingArgument(f"inputs of {s.operation}: {names}")
        bundle = given[0]
        args = file_arguments(s.args)
        args = [args] if isinstance(args, dict) else list(args)
        if s.operation in OPERANDS:
            args = [inputs.get(a, a) if isinstance(a, str) else a for a in args]
            if any(isinstance(a, str) for a in args):
                raise MissingArgument(f"an input named {[a for a in args if isinstance(a, str)]}")
        if s.options.get("verbose"):
            logging.getLogger("quire").info("%s %s", s.operation, s.args)
        if len(given) > 1 and s.operation in ("cat", "shuffle"):
            bundle, marks = merge(given, s)
            now = one_document(call(s.operation, bundle, *args, handles=marks))
        elif s.operation == "filter":
            now = bundle
        else:
            now = call(s.operation, bundle, *args)
        now = with_options(now, {k: v for k, v in s.options.items() if k not in IDS} | last)
        if "output" in s.options and sink is not None:
            sink(now, s.options["output"], **writer_options(s.options))
    if now is None:
        raise InvalidCommand("no stage")
    return now


def merge(given: Sequence[Bundle], stage: Stage) -> tuple[Bundle, dict[str, str]]:
    """The inputs of one command as one set: the nth documents of all inputs go together (set_id)."""
    marks = dict(stage.handles) or {chr(65 + i): n for i, n in enumerate(stage.inputs)}
    free = iter(c for c in map(chr, range(90, 64, -1)) if c not in marks)
    for n in stage.inputs:
        if n not in marks.values():
            marks["_" if n == "_" else next(free)] = n
    of = {n: h for h, n in marks.items()}
    frames: dict[str, DataFrame] = {}
    for i, (name, b) in enumerate(zip(stage.inputs, given, strict=True)):
        rows = b["pages"].drop("handle", "input_idx")
        rows = (rows if "set_id" in rows.columns else rows.withColumn("set_id", F.col("doc_id"))).withColumn("handle", F.lit(of[name])).withColumn("input_idx", F.lit(i))
        own = {"pages": rows} | {k: b[k].drop("input_idx").withColumn("input_idx", F.lit(i)) for k in FOLLOWING if k in b.relations}
        for k, f in own.items():
            frames[k] = frames[k].unionByName(f, allowMissingColumns=True) if k in frames else f
    return Bundle({**given[0].relations, **frames}), marks


def one_document(bundle: Bundle) -> Bundle:
    """What a command over several inputs has made as documents of their own: doc_id is the set's, src_doc and src_handle say where a page comes from."""
    rows = bundle["pages"].drop("src_doc", "src_handle", "input_idx").withColumnRenamed("handle", "src_handle")
    frames = {k: f.drop("input_idx") if k in FOLLOWING else f for k, f in bundle.relations.items()}
    return Bundle({**frames, "pages": rows.withColumnRenamed("doc_id", "src_doc").withColumnRenamed("set_id", "doc_id")}, bundle.report)
