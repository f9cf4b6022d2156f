"""Authored vector-space specifications: parsing, validation, canonical JSON and what is compiled from it.

A specification is a small indented text with a fixed grammar.  It is read on
the driver; its parts become DataFrames.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import embed
from ..plans.search import InvalidArgument

# -- reading -------------------------------------------------------------------------------------


class Number(str):
    """A number as written, so that writing it again changes nothing."""


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _uncommented(line: str) -> str:
    """Without what follows a # outside quotes, at the start or after a blank."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def _split(text: str, at: str = ",") -> list[str]:
    """Parts between ``at`` that is outside quotes and brackets."""
    out, depth, quote, part = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == at and not depth:
            out.append(part)
            part = ""
            continue
        part += c
    return [p.strip() for p in [*out, part] if p.strip()]


def _pair(text: str) -> tuple[str, str]:
    parts = _split(text.strip(), ":")
    key = parts[0]
    return key.strip("\"'"), text.strip()[len(key) + 1 :].strip()


def scalar(text: str):
    """Quoted text is text; true, false, null and numbers are what they look like; brackets hold more."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(p) for p in _split(text[1:-1])]
    if text.startswith("{") and text.endswith("}"):
        return {k: scalar(v) for k, v in map(_pair, _split(text[1:-1]))}
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    return Number(text) if _NUMBER.fullmatch(text) else text


def parse(text: str) -> dict:
    """The text's tree: dicts, lists, text, Number, bool, None."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for raw in text.splitlines() if (x := _uncommented(raw).rstrip()).strip()]
    at = 0

    def block(indent: int):
        nonlocal at
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1][:1] == "-":
                rest = lines[at][1][1:].strip()
                if _is_pair(rest):
                    lines[at] = (indent + 2, rest)
                    out.append(block(indent + 2))
                elif rest:
                    out.append(scalar(rest))
                    at += 1
                else:
                    at += 1
                    out.append(block(lines[at][0]))
            return out
        tree: dict = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            if not _is_pair(lines[at][1]):
                raise InvalidArgument(f"not a key and a value: {lines[at][1]!r}")
            key, value = _pair(lines[at][1])
            at += 1
            deeper = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- ")))
            tree[key] = scalar(value) if value else block(lines[at][0]) if deeper else ""
        return tree

    tree = block(lines[0][0]) if lines else {}
    if at < len(lines):
        raise InvalidArgument(f"wrong indentation: {lines[at][1]!r}")
    return tree


def _is_pair(text: str) -> bool:
    if text[:1] in "\"'[{":
        return bool(re.match(r"([\"']).*?\1:(\s|$)", text))
    return bool(re.match(r"[^\s:]+:(\s|$)", text))


# -- what a specification has ----------------------------------------------------------------------

# Fields in the order they are written: (name, kind, whether it must be there).  Kinds: text, texts,
# int, real, value (number or text), tree (anything), or the fields of a part, alone or in a list.
EMBEDDER = (
    ("id", "text", True), ("version", "text", True), ("input_schema", "text", True), ("preprocess_chain", "texts", True), ("model_hash", "text", True),
    ("config_hash", "text", True), ("hardware_class", "text", True), ("min_ram_mb", "int", True), ("min_vram_mb", "int", True), ("signature", "text", False),
)
INVARIANT = (("type", "text", True), ("equals", "value", False), ("allowed", "texts", False), ("min", "real", False), ("max", "real", False))
SPACE = (("space_id", "text", True), ("dim", "int", True), ("metric", "text", True), ("normalization", "text", True), ("transform_chain", "texts", False), ("invariants", [INVARIANT], False))
OBJECTIVE = (("objective_id", "text", True), ("description", "text", False), ("target_mints", "texts", True), ("priority", "int", False))
MINT = (("mint_id", "text", True), ("space_id", "text", True), ("text", "text", True), ("tags", "texts", False), ("metadata", "tree", False))
CORRIDOR = (("corridor_id", "text", True), ("space_id", "text", True), ("between", "texts", True), ("width", "real", True), ("risk_profile", "text", False), ("notes", "text", False))
TRACE = (
    ("trace_id", "text", True), ("space_id", "text", True), ("steps", "texts", True), ("confidence", "real", False), ("timestamps", "texts", False),
    ("notes", "text", False), ("metadata", "tree", False),
)
SPEC = (
    ("spec_version", "text", True), ("spec_id", "text", True), ("title", "text", False), ("created_at", "text", True), ("owner", "text", True), ("notes", "text", False),
    ("embedder", EMBEDDER, True), ("entry_mints", "texts", False), ("objectives", [OBJECTIVE], False), ("spaces", [SPACE], True), ("mints", [MINT], True),
    ("corridors", [CORRIDOR], False), ("traces", [TRACE], False),
)


def quoted(text) -> str:
    text = str(text).rstrip(" ")
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def real(value) -> str:
    """Twelve significant digits; plain from 0.1 to below 1e12, else with an exponent."""
    x = float(value)
    if x == 0:
        return "0.00000000000"
    digits, exponent = f"{abs(x):.11e}".split("e")
    power, sign = int(exponent) + 1, "-" if x < 0 else ""
    if 0 <= power <= 12:
        return f"{sign}{abs(x):.{12 - power}f}" + ("." if power == 12 else "")
    return f"{sign}0.{digits.replace('.', '')}E{power:+03d}"


def _tree(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{quoted(k)}: {_tree(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_tree, value)) + "]"
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return str(value) if isinstance(value, Number) else quoted(value)


def canonical(value, kind) -> str:
    """A field's canonical JSON: fixed order of keys, ``": "`` and ``","`` between."""
    if isinstance(kind, tuple):
        return "{" + ",".join(f"{quoted(n)}: {canonical(value[n], k)}" for n, k, must in kind if n in value and (must or value[n] != "")) + "}"
    if isinstance(kind, list):
        return "[" + ",".join(canonical(v, kind[0]) for v in value) + "]"
    if kind == "texts":
        return "[" + ",".join(quoted(_plain(v)) for v in value) + "]"
    if kind == "value":
        return str(value) if isinstance(value, Number) else quoted(_plain(value))
    return {"text": lambda: quoted(_plain(value)), "int": lambda: str(int(value)), "real": lambda: real(value), "tree": lambda: _tree(value)}[kind]()


def _plain(value) -> str:
    return {True: "true", False: "false", None: "null"}.get(value, value) if isinstance(value, bool) or value is None else value


def _check(value: dict, fields, where: str, problems: list[str]) -> None:
    if not isinstance(value, dict):
        problems.append(f"{where} isn't a part with fields")
        return
    kinds = {n: k for n, k, _ in fields}
    problems += [f"{where} has no field {n!r}" for n in value if n not in kinds]
    for name, kind, must in fields:
        got = value.get(name)
        if got in (None, "", []) and name not in ("metadata",):
            if must:
                problems.append(f"{where}.{name} is missing")
            continue
        if isinstance(kind, list):
            for i, part in enumerate(got if isinstance(got, list) else []):
                _check(part, kind[0], f"{where}.{name}[{i}]", problems)
        elif isinstance(kind, tuple):
            _check(got, kind, f"{where}.{name}", problems)
        elif kind in ("int", "real") and not _NUMBER.fullmatch(str(got)):
            problems.append(f"{where}.{name} isn't a number")
        elif kind == "texts" and not isinstance(got, list):
            problems.append(f"{where}.{name} isn't a list")


@dataclass(frozen=True)
class Spec:
    tree: dict

    @classmethod
    def read(cls, text: str, strict: bool = False) -> Spec:
        """A valid specification, or InvalidArgument with all that is wrong."""
        spec = cls(parse(text))
        if problems := spec.problems(strict):
            raise InvalidArgument("; ".join(problems))
        return spec

    def part(self, name: str) -> list[dict]:
        return self.tree.get(name) or []

    def problems(self, strict: bool = False) -> list[str]:
        found: list[str] = []
        _check(self.tree, SPEC, "spec", found)
        if found:
            return found
        spaces, mints = {s["space_id"] for s in self.part("spaces")}, {m["mint_id"] for m in self.part("mints")}
        found += [f"space {s['space_id']}: dim {s['dim']}" for s in self.part("spaces") if float(s["dim"]) <= 0]
        for name, kind, key in (("mints", "mint", "mint_id"), ("corridors", "corridor", "corridor_id"), ("traces", "trace", "trace_id")):
            found += [f"{kind} {x[key]}: no space {x['space_id']}" for x in self.part(name) if x["space_id"] not in spaces]
        used = [("entry_mints", m) for m in self.part("entry_mints")]
        for name, key, field in (("objectives", "objective_id", "target_mints"), ("corridors", "corridor_id", "between"), ("traces", "trace_id", "steps")):
            used += [(f"{name} {x[key]}", m) for x in self.part(name) for m in x[field]]
        found += [f"{where}: no mint {m}" for where, m in used if m not in mints]
        found += [f"trace {t['trace_id']}: confidence {t['confidence']}" for t in self.part("traces") if "confidence" in t and not 0 <= float(t["confidence"]) <= 1]
        if strict:
            e = self.tree["embedder"]
            found += [] if e["hardware_class"] in ("any", "cpu", "gpu", "npu", "hybrid") else [f"hardware class {e['hardware_class']}"]
            found += [f"corridor {c['corridor_id']}: fewer than two mints" for c in self.part("corridors") if len(c["between"]) < 2]
            found += [f"corridor {c['corridor_id']}: width {c['width']}" for c in self.part("corridors") if float(c["width"]) < 0]
        return found

    # -- compiled texts

    def manifest(self) -> str:
        return canonical(self.tree, SPEC)

    def contracts(self) -> str:
        embedder = canonical({k: v for k, v in self.tree["embedder"].items() if k != "signature"}, EMBEDDER)
        spaces = [canonical(s, SPACE) for s in self.part("spaces")]
        entry = lambda text, signature: f'{{"spec": {text},"contract_hash": {quoted(digest(text))},"signature": {quoted(signature)}}}'
        own = entry(embedder, self.tree["embedder"].get("signature", ""))
        return f'{{"spec_id": {quoted(self.tree["spec_id"])},"embedder": {own},"spaces":[' + ",".join(entry(s, "") for s in spaces) + "]}"

    def layout(self) -> dict:
        """Where each space's and mint's vector is in the payload: spaces one after the other."""
        offset, spaces = 0, []
        for s in self.part("spaces"):
            stride, own = 4 * int(s["dim"]), [m["mint_id"] for m in self.part("mints") if m["space_id"] == s["space_id"]]
            mints = [{"mint_id": m, "index": i, "offset_bytes": offset + i * stride} for i, m in enumerate(own)]
            spaces.append({"space_id": s["space_id"], "dim": int(s["dim"]), "count": len(own), "byte_stride": stride, "offset_bytes": offset, "mints": mints})
            offset += stride * len(own)
        return {"dtype": "float32", "endianness": "little", "total_vectors": len(self.part("mints")), "total_bytes": offset, "spaces": spaces}

    def layout_json(self) -> str:
        tree = self.layout()
        pair = lambda k, v: f"{quoted(k)}: {v if isinstance(v, int) else quoted(v)}"
        flat = lambda x: ",".join(pair(k, v) for k, v in x.items() if not isinstance(v, list))
        spaces = ["{" + flat(s) + ',"mints":[' + ",".join("{" + flat(m) + "}" for m in s["mints"]) + "]}" for s in tree["spaces"]]
        return "{" + flat(tree) + ',"spaces":[' + ",".join(spaces) + "]}"

    def payload(self) -> bytes:
        """The mints' vectors in the layout's order."""
        out = []
        for s in self.part("spaces"):
            out += [embed(_plain(m["text"]), int(s["dim"]), s["normalization"]) for m in self.part("mints") if m["space_id"] == s["space_id"]]
        return np.concatenate(out).astype("<f4").tobytes() if out else b""

    def dot(self) -> str:
        """A graph: mints, corridors dashed, the steps of traces."""
        edge = lambda a, b, label, style="": f"  {quoted(a)} -> {quoted(b)} [{style}label={quoted(label)}];"
        lines = ["digraph Spec {", "  rankdir=LR;", *(f"  {quoted(m['mint_id'])} [label={quoted(m['mint_id'])}];" for m in self.part("mints"))]
        lines += [edge(*c["between"][:2], c["corridor_id"], "style=dashed,") for c in self.part("corridors") if len(c["between"]) > 1]
        lines += [edge(a, b, t["trace_id"]) for t in self.part("traces") for a, b in zip(t["steps"], t["steps"][1:], strict=False)]
        return "\n".join([*lines, "}", ""])

    # -- tables

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """spaces, mints, corridors, traces, objectives as DataFrames."""
        name, table = self.tree["spec_id"], {}
        texts = lambda x: [str(_plain(v)) for v in x] if x else None
        number = lambda x: float(x) if x is not None else None
        table["spaces"] = ([(name, s["space_id"], int(s["dim"]), s["metric"], s["normalization"], texts(s.get("transform_chain"))) for s in self.part("spaces")], "spec_id string, space_id string, dim int, metric string, normalization string, transform_chain array<string>")
        table["mints"] = ([(name, i, m["mint_id"], m["space_id"], str(_plain(m["text"])), texts(m.get("tags")), _tree(m["metadata"]) if m.get("metadata") else None) for i, m in enumerate(self.part("mints"))], "spec_id string, ord int, mint_id string, space_id string, text string, tags array<string>, metadata string")
        table["corridors"] = ([(c["corridor_id"], c["space_id"], texts(c["between"]), number(c["width"]), c.get("risk_profile"), c.get("notes")) for c in self.part("corridors")], "corridor_id string, space_id string, between array<string>, width double, risk_profile string, notes string")
        table["traces"] = ([(t["trace_id"], t["space_id"], texts(t["steps"]), number(t.get("confidence")), texts(t.get("timestamps")), t.get("notes")) for t in self.part("traces")], "trace_id string, space_id string, steps array<string>, confidence double, timestamps array<string>, notes string")
        table["objectives"] = ([(o["objective_id"], o.get("description"), texts(o["target_mints"]), int(o["priority"]) if o.get("priority") else None) for o in self.part("objectives")], "objective_id string, description string, target_mints array<string>, priority int")
        return {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in table.items()}


def digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
