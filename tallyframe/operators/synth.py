"""Examples from templates; their labels are right by construction.

A template is a header (family, lang, weight, label.NAME), a line `---` and a body of text with
directives. Templates are few and are parsed once, on the driver; examples are rendered where
Spark puts them, each from a generator seeded by its own number, so that neither partitions nor
the number of examples change what number i looks like.

    {{pick:set}} {{pick:set:slot}}     a gazetteer's value; a slot keeps its value in the example
    {{one:a|b}}  {{one}}a{{|}}b{{/one}}  one of several
    {{int:1-9}} {{digits:4}} {{pad:1-3}} numbers and spaces
    [?name:0.3]..[/]                   left out or not; a name decides once in a template
    @block name .. @end, {{LINES:name:1-3}}  lines of a block
    {{x:name|p=0.5}}..{{/x}}           a transform of what is rendered inside
    {{include:glob|p=0.5}}             another template of such a family, with its labels
    {{label:name=value}}  {{user}}     sets a label; parts context from text
"""

from __future__ import annotations

import base64
import bisect
import codecs
import json
import random
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HOMOGLYPH, LEET, family_pattern

OPTIONAL_RATE, MAX_DEPTH, ALPHA = 0.5, 3, 0.6


@dataclass
class Part:
    """One piece of a body. body: what it holds, a list of alternatives where it chooses."""

    kind: str
    arg: object = None
    p: float = 1.0
    body: list = field(default_factory=list)


@dataclass
class Template:
    name: str
    family: str = ""
    lang: str = ""
    weight: float = 1.0
    labels: dict = field(default_factory=dict)
    blocks: dict[str, list[Part]] = field(default_factory=dict)
    body: list[Part] = field(default_factory=list)


# ---- transforms


def _swap(pair: tuple[str, str], chance: float) -> Callable[[str, random.Random], str]:
    table = dict(zip(*pair))
    return lambda s, rnd: "".join(table[c] if c in table and rnd.random() < chance else c for c in s)


def _after(extra: str, chance: float, fits: Callable[[str], bool]) -> Callable[[str, random.Random], str]:
    return lambda s, rnd: "".join(c + extra if fits(c) and rnd.random() < chance else c for c in s)


#: Named transforms of a rendered text; callers may add their own before they parse.
TRANSFORMS: dict[str, Callable[[str, random.Random], str]] = {
    "upper": lambda s, _: s.upper(),
    "lower": lambda s, _: s.lower(),
    "base64": lambda s, _: base64.b64encode(s.encode()).decode(),
    "hex": lambda s, _: s.encode().hex(),
    "rot13": lambda s, _: codecs.encode(s, "rot13"),
    "spaced": lambda s, _: re.sub(r"(?<=.)(?=[^ ])", " ", s, flags=re.S),
    "leet": _swap(LEET, 0.7),
    "homoglyph": _swap(HOMOGLYPH, 0.5),
    "zwsp": _after("​", 0.3, str.isalpha),
    "noise": _after(" ", 0.35, lambda c: c not in " \n"),
}


# ---- parsing


def label_value(text: str):
    """true, false, a number, or else the text."""
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        number = float(text)
        return int(number) if number.is_integer() else number
    return text


def _bounds(spec: str, inner: str) -> tuple[int, int]:
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", spec)
    lo, hi = (int(m[1]), int(m[2] or m[1])) if m else (1, 0)
    if lo > hi:
        raise ValueError(f"{{{{{inner}}}}}: bad bounds")
    return lo, hi


def _chance(text: str, where: str) -> float:
    try:
        p = float(text)
    except ValueError:
        p = -1.0
    if not 0 <= p <= 1:
        raise ValueError(f"{where}: bad probability")
    return p


def _ends(src: str, at: int) -> int:
    """Where the braces that open at `at` are closed again."""
    depth = 0
    for m in re.compile(r"\{\{|\}\}").finditer(src, at):
        depth += 1 if m[0] == "{{" else -1
        if not depth:
            return m.start()
    raise ValueError("'{{' is not closed")


def _alternatives(spec: str) -> list[str]:
    out, depth = [""], 0
    for bit in re.split(r"(\{\{|\}\}|\|)", spec):
        depth += (bit == "{{") - (bit == "}}")
        if bit == "|" and not depth:
            out.append("")
        else:
            out[-1] += bit
    return out


def _part(inner: str) -> Part:
    """A directive from what stands between its braces; `one`, `x` and their like get their body later."""
    head, _, options = inner.partition("|")
    kind, colon, spec = head.partition(":")
    bad = ValueError(f"{{{{{inner}}}}}: not understood")
    if kind == "one":
        return Part("one", body=[parse_body(a.replace("\\n", "\n")) for a in _alternatives(inner[4:])]) if colon else Part("one", "open", body=[[]])
    if kind == "user":
        if colon or options:
            raise bad
        return Part("user")
    if not colon:
        raise bad
    if kind == "pick":
        return Part("pick", spec.partition(":")[::2])
    if kind in ("int", "pad"):
        return Part(kind, _bounds(spec, inner))
    if kind == "digits" and spec.isdecimal() and 0 < int(spec) <= 64:
        return Part(kind, int(spec))
    if kind == "LINES" and ":" in spec:
        block, _, bounds = spec.partition(":")
        return Part("lines", (block, *_bounds(bounds, inner)))
    if kind == "label" and spec.partition("=")[0] and "=" in spec:
        name, _, value = spec.partition("=")
        return Part("label", (name, label_value(value)))
    if kind in ("x", "include") and spec:
        given = dict(part.split("=", 1) if "=" in part else (part, None) for part in map(str.strip, options.split("|")) if part)
        if None in given.values() or (kind == "x" and spec not in TRANSFORMS):
            raise bad
        return Part(kind, spec, _chance(given.get("p", "1").strip(), inner))
    raise bad


def parse_body(src: str) -> list[Part]:
    root = Part("root", body=[[]])
    open_parts, at = [root], 0
    put = lambda part: open_parts[-1].body[-1].append(part)
    marks = re.compile(r"\{\{|\[\?|\[/\]|\}\}")
    while at < len(src):
        m = marks.search(src, at)
        if not m:
            put(Part("text", src[at:]))
            break
        if m.start() > at:
            put(Part("text", src[at : m.start()]))
        at, mark, top = m.end(), m[0], open_parts[-1]
        if mark == "}}":
            raise ValueError("'}}' without '{{'")
        if mark == "[/]":
            if top.kind == "maybe":
                open_parts.pop()
            else:
                put(Part("text", mark))
        elif mark == "[?":
            end = src.find("]", at)
            if end < 0:
                raise ValueError("'[?' is not closed")
            name, colon, p = src[at:end].partition(":")
            part = Part("maybe", name, _chance(p, name) if colon else -1.0, [[]])
            put(part)
            open_parts.append(part)
            at = end + 1
        else:
            end = _ends(src, m.start())
            inner, at = src[at:end], end + 2
            if inner == "|" and top.kind == "one":
                top.body.append([])
            elif inner in ("/one", "/x") and top.kind == inner[1:]:
                open_parts.pop()
            else:
                part = _part(inner)
                put(part)
                if part.kind == "x" or part.arg == "open":
                    part.body = part.body or [[]]
                    open_parts.append(part)
    if len(open_parts) > 1:
        raise ValueError(f"a section is not closed: {open_parts[-1].kind}")
    return root.body[0]


def parse_template(name: str, src: str) -> Template:
    head, rule, body = re.match(r"(?s)(?P<head>.*?)^[ \t\r]*(?P<rule>---)[ \t\r]*(?:\n|\Z)(?P<body>.*)\Z", src, re.M).group("head", "rule", "body") if re.search(r"(?m)^[ \t\r]*---[ \t\r]*$", src) else (src, "", "")
    if not rule:
        raise ValueError(f"{name}: no line '---' ends the header")
    out = Template(name)
    for line in filter(None, map(str.strip, head.split("\n"))):
        if line.startswith("#"):
            continue
        key, colon, value = (x.strip() for x in line.partition(":"))
        if key in ("family", "lang") and colon:
            setattr(out, key, value)
        elif key == "weight" and re.fullmatch(r"\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value):
            out.weight = float(value)
        elif key.startswith("label.") and len(key) > 6 and colon:
            out.labels[key[6:]] = label_value(value)
        else:
            raise ValueError(f"{name}: header line {line!r}")
    if not out.family:
        raise ValueError(f"{name}: a family is needed")
    lines, block = [], None
    for line in body.split("\n"):
        bare = line.strip()
        if bare.startswith("@block "):
            block_name = bare[7:].strip()
            if block is not None or not block_name or block_name in out.blocks:
                raise ValueError(f"{name}: @block {block_name!r} is nested, nameless or repeated")
            block = []
        elif bare == "@end":
            if block is None:
                raise ValueError(f"{name}: @end without @block")
            out.blocks[block_name], block = parse_body("\n".join(block)), None
        else:
            (lines if block is None else block).append(line)
    if block is not None:
        raise ValueError(f"{name}: @block {block_name!r} is not closed")
    out.body = parse_body("\n".join(lines).removesuffix("\n"))
    for part in every_part(out):
        if part.kind == "lines" and part.arg[0] not in out.blocks:
            raise ValueError(f"{name}: no @block {part.arg[0]!r}")
    return out


def every_part(template: Template):
    """All parts of body and blocks, at any depth."""
    todo = [template.body, *template.blocks.values()]
    while todo:
        for part in todo.pop():
            yield part
            todo += part.body


# ---- corpora


class Gazetteer:
    """Weighted values: weights are raised to alpha, which flattens them (zero or less: 1)."""

    def __init__(self, entries: list[tuple[str, float]], alpha: float = ALPHA, least: float = 0.0):
        kept = [(v, w ** (alpha if alpha > 0 else 1.0)) for v, w in entries if w > 0 and w >= least]
        if not kept:
            raise ValueError("a gazetteer is empty")
        self.values, self.cum, total = [v for v, _ in kept], [], 0.0
        for _, w in kept:
            total += w
            self.cum.append(total)

    def pick(self, rnd: random.Random) -> str:
        return self.values[min(bisect.bisect_left(self.cum, rnd.random() * self.cum[-1]), len(self.cum) - 1)]


class Corpus:
    def __init__(self, templates: list[Template], gazetteers: dict[str, Gazetteer]):
        self.templates, self.gazetteers = sorted(templates, key=lambda t: t.name), gazetteers
        self.roots = [t for t in self.templates if t.weight > 0]
        patterns = {part.arg for t in self.templates for part in every_part(t) if part.kind == "include"}
        self.included = {p: [t for t in self.templates if re.match(family_pattern(p), t.family)] for p in patterns}
        if not self.roots:
            raise ValueError("no template has a weight above zero")
        if lost := sorted(p for p, found in self.included.items() if not found):
            raise ValueError(f"no template for include {lost[0]!r}")
        if lost := sorted(part.arg[0] for t in self.templates for part in every_part(t) if part.kind == "pick" and part.arg[0] not in gazetteers):
            raise ValueError(f"no gazetteer {lost[0]!r}")

    def root(self, u: float) -> Template:
        goal = u * sum(t.weight for t in self.roots)
        for t in self.roots:
            goal -= t.weight
            if goal < 0:
                return t
        return self.roots[-1]

    def render(self, template: Template, seed: int, optional_rate: float = OPTIONAL_RATE, max_depth: int = MAX_DEPTH) -> dict:
        """context, text, labels, family and meta of one example."""
        run = _Run(self, seed, optional_rate, max_depth)
        text, labels = run.template(template, 0)
        context = ""
        if run.split is not None:
            context, text = text[: run.split].strip(), text[run.split :].lstrip(" \n")
        meta = {"template": template.name, "seed": str(seed)} | ({"lang": template.lang} if template.lang else {}) | ({"includes": ",".join(sorted(run.families))} if run.families else {})
        return {"context": context, "text": text, "labels": labels, "family": template.family, "meta": meta}


class _Run:
    """What one example shares between its templates."""

    def __init__(self, corpus: Corpus, seed: int, optional_rate: float, max_depth: int):
        self.corpus, self.rate, self.max_depth = corpus, optional_rate, max_depth
        self.rnd, self.slots, self.families, self.split = random.Random(seed), {}, set(), None

    def template(self, t: Template, depth: int) -> tuple[str, dict]:
        frame = (t, depth, dict(t.labels), {})
        return self.parts(t.body, frame), frame[2]

    def parts(self, parts: list[Part], frame: tuple) -> str:
        out: list[str] = []
        self.into(out, parts, frame)
        return "".join(out)

    def into(self, out: list[str], parts: list[Part], frame: tuple) -> None:
        t, depth, labels, decided = frame
        rnd = self.rnd
        for part in parts:
            match part.kind:
                case "text":
                    out.append(part.arg)
                case "pick":
                    source, slot = self.corpus.gazetteers[part.arg[0]], part.arg[1]
                    if slot and part.arg not in self.slots:
                        self.slots[part.arg] = source.pick(rnd)
                    out.append(self.slots[part.arg] if slot else source.pick(rnd))
                case "one":
                    self.into(out, rnd.choice(part.body), frame)
                case "int":
                    out.append(str(rnd.randint(*part.arg)))
                case "digits":
                    out.append("".join(rnd.choice("0123456789") for _ in range(part.arg)))
                case "pad":
                    out.append(" " * rnd.randint(*part.arg))
                case "lines":
                    block, lo, hi = part.arg
                    for _ in range(rnd.randint(lo, hi)):
                        self.into(out, t.blocks[block], frame)
                        out.append("\n")
                case "maybe":
                    if part.arg not in decided:
                        decided[part.arg] = rnd.random() < (self.rate if part.p < 0 else part.p)
                    if decided[part.arg]:
                        self.into(out, part.body[0], frame)
                case "x":
                    inner = self.parts(part.body[0], frame)
                    out.append(TRANSFORMS[part.arg](inner, rnd) if rnd.random() < part.p else inner)
                case "include":
                    if rnd.random() >= part.p:
                        continue
                    if depth >= self.max_depth:
                        raise ValueError(f"{t.name}: includes deeper than {self.max_depth}")
                    sub = rnd.choice(self.corpus.included[part.arg])
                    text, found = self.template(sub, depth + 1)
                    out.append(text)
                    self.families.add(sub.family)
                    labels.update({k: v for k, v in found.items() if labels.get(k) is not True})
                case "label":
                    labels[part.arg[0]] = part.arg[1]
                case "user":
                    if depth:  # an included template's context has no place in its host
                        out.clear()
                    elif self.split is not None:
                        raise ValueError(f"{t.name}: {{{{user}}}} twice")
                    else:
                        self.split = sum(map(len, out))


def read_corpus(spark: SparkSession, path: str, alpha: float = ALPHA, least: float = 0.0) -> Corpus:
    """All *.tmpl (named by their path) and *.tsv (by their file name) below a folder of any store; small files, read on the driver."""
    root = re.sub(r"^\w+:/*", "/", path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tmpl,tsv}").load(path).select("path", "content").orderBy("path").collect()
    templates, gazetteers = [], {}
    for full, content in files:
        name, _, kind = full.split(root, 1)[-1].rpartition(".")
        if kind == "tmpl":
            templates.append(parse_template(name, content.decode()))
            continue
        short = name.rpartition("/")[2]
        if short in gazetteers:
            raise ValueError(f"gazetteer {short!r} twice")
        rows = [(line.rstrip("\r").split("\t") + [""])[:2] for line in content.decode().split("\n") if line.strip() and not line.startswith("#")]
        gazetteers[short] = Gazetteer([(v.strip(), float(w) if w.strip() else 1.0) for v, w in rows if v.strip()], alpha, least)
    return Corpus(templates, gazetteers)


# ---- generation


def example_seed(seed: int, i: int) -> int:
    """FNV-1a, 64 bits, of 'seed/i'."""
    h = 0xCBF29CE484222325
    for b in f"{seed}/{i}".encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def draws(spark: SparkSession, corpus: Corpus, lo: int, hi: int, seed: int, optional_rate: float = OPTIONAL_RATE, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Examples number lo to hi - 1, with their number."""
    shared = spark.sparkContext.broadcast(corpus)  # templates and lists that one driver has read

    def run(batches):
        corpus = shared.value
        for batch in batches:
            made = []
            for i in batch.column(0).to_pylist():
                own = example_seed(seed, i)
                e = corpus.render(corpus.root(random.Random(own ^ 0x5EED).random()), own, optional_rate, max_depth)
                made.append((i, e["context"], e["text"], json.dumps(e["labels"], ensure_ascii=False), e["family"], list(e["meta"].items())))
            if made:
                kinds = [pa.int64(), *[pa.string()] * 4, pa.map_(pa.string(), pa.string())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["i", "context", "text", "labels", "family", "meta"])

    rows = spark.range(lo, hi).mapInArrow(run, "i bigint, context string, text string, labels string, family string, meta map<string,string>")
    return rows.withColumn("labels", F.parse_json("labels"))


def synthesize(spark: SparkSession, corpus: Corpus, n: int, seed: int = 1, optional_rate: float = OPTIONAL_RATE, max_depth: int = MAX_DEPTH, dedupe: bool = False) -> DataFrame:
    """n examples. dedupe: the first n whose context and text are new, of 20 n + 100 draws at most; fewer is an error."""
    if not dedupe:
        return draws(spark, corpus, 0, n, seed, optional_rate, max_depth)
    most, hi = 20 * n + 100, min(20 * n + 100, n + n // 4 + 100)
    while True:
        drawn = draws(spark, corpus, 0, hi, seed, optional_rate, max_depth)
        first = drawn.groupBy(F.coalesce("context", F.lit("")).alias("c"), F.col("text").alias("t")).agg(F.min("i").alias("i")).select("i")
        wide = max(1, -(-hi // 4096))
        per = sorted(first.groupBy(F.expr(f"i div {wide}").alias("b")).count().collect())  # 4096 rows at most
        have = sum(r["count"] for r in per)
        if have >= n or hi == most:
            break
        hi = min(most, 2 * hi)
    if have < n:
        raise ValueError(f"{have} distinct examples in {hi} draws; the templates have too little variety")
    left, cut = n, 0
    for bucket, count in per:
        if count >= left:
            inside = sorted(r["i"] for r in first.where(F.expr(f"i div {wide}") == bucket).collect())  # `wide` rows at most
            cut = inside[left - 1] if left else -1
            break
        left -= count
    return drawn.join(first.where(F.col("i") <= cut), "i")
