"""Turtle metadata: a reader of the subset that containers use, and a writer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
LANG = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"

_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*)+)|<(?P<iri>[^<>\s]*(?:[ ][^<>\n]*)?)>|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})|"(?P<text>(?:[^"\\\n]|\\.)*)"|'(?P<quote>(?:[^'\\\n]|\\.)*)'
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<mark>\^\^|[;,.](?=\s|$|[<"\[\]#;,.@])|[\[\]()])|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)(?=[\s;,.\])]|$)|(?P<name>(?:[A-Za-z][\w.-]*)?:(?:[\w.:%-]*[\w:%-])?)|(?P<word>[A-Za-z]+)""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_NAMED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class Statement(NamedTuple):
    seq: int
    subject: str
    predicate: str
    obj_kind: str
    obj_lexical: str
    obj_datatype: str | None


class Malformed(ValueError):
    """Text that isn't Turtle of the subset; says where."""


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _NAMED.get(m[1], m[1]), text) if "\\" in text else text


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise Malformed(f"character {at}: {text[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            yield m.lastgroup, m[m.lastgroup]
    yield "end", ""


def prefixes(text: str) -> dict[str, str]:
    """The namespaces that a document declares; the first declaration of a prefix counts."""
    out: dict[str, str] = {}
    for name, iri in re.findall(r"(?im)^\s*@?prefix\s+([\w.-]*):\s*<([^>]*)>", text):
        out.setdefault(name, iri)
    return out


def parse(text: str) -> Iterator[Statement]:
    """The statements of a document in order. Statements about or to blank nodes are left out."""
    tokens, known, base, seq = _tokens(text), {}, "", 0

    def term(kind: str, value: str) -> tuple[str, str]:
        if kind == "iri":
            return "iri", value if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else base + value
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in known:
                raise Malformed(f"prefix {prefix!r} isn't declared")
            return "iri", known[prefix] + local
        if kind == "word" and value == "a":
            return "iri", RDF_TYPE
        if kind == "blank":
            return "blank", value
        raise Malformed(f"{value!r} where a name should be")

    kind, value = next(tokens)
    while kind != "end":
        if (kind == "lang" and value in ("@prefix", "@base")) or (kind == "word" and value.lower() in ("prefix", "base")):
            at_form, what = kind == "lang", value.lower().lstrip("@")
            kind, value = next(tokens)
            name = ""
            if what == "prefix":
                if kind != "name" or not value.endswith(":"):
                    raise Malformed(f"{value!r} isn't a prefix")
                name = value[:-1]
                kind, value = next(tokens)
            if kind != "iri":
                raise Malformed(f"{value!r} isn't an IRI")
            if what == "prefix":
                known[name] = value
            else:
                base = value
            kind, value = next(tokens)
            if at_form:
                if value != ".":
                    raise Malformed("a directive must end with a full stop")
                kind, value = next(tokens)
            continue
        s_kind, subject = term(kind, value)
        kind, value = next(tokens)
        while True:
            _, predicate = term(kind, value)
            while True:
                kind, value = next(tokens)
                if kind in ("text", "quote", "long"):
                    lexical, datatype = _plain(value[3:-3] if kind == "long" else value), XSD + "string"
                    kind, value = next(tokens)
                    if kind == "lang":
                        datatype = LANG
                        kind, value = next(tokens)
                    elif value == "^^" and kind == "mark":
                        datatype = term(*next(tokens))[1]
                        kind, value = next(tokens)
                    obj = ("literal", lexical, datatype)
                elif kind == "number":
                    obj = ("literal", value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
                    kind, value = next(tokens)
                elif kind == "word" and value in ("true", "false"):
                    obj = ("literal", value, XSD + "boolean")
                    kind, value = next(tokens)
                else:
                    o_kind, o = term(kind, value)
                    obj = (o_kind, o, None)
                    kind, value = next(tokens)
                if s_kind == "iri" and obj[0] != "blank":
                    yield Statement(seq, subject, predicate, *obj)
                    seq += 1
                if (kind, value) != ("mark", ","):
                    break
            ends = False
            while (kind, value) == ("mark", ";"):
                kind, value = next(tokens)
                ends = True
            if (kind, value) == ("mark", "."):
                kind, value = next(tokens)
                break
            if not ends:
                raise Malformed(f"{value!r} after an object")


def _literal(text: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f'"{text}"'


def serialize(statements: Iterable[Statement], namespaces: dict[str, str]) -> str:
    """Turtle with subjects in the order of first mention, types first, predicates grouped."""
    order = sorted(namespaces.items(), key=lambda kv: -len(kv[1]))

    def short(iri: str) -> str:
        for name, space in order:
            if iri.startswith(space) and re.fullmatch(r"[A-Za-z_][\w-]*", iri[len(space) :]):
                return f"{name}:{iri[len(space):]}"
        return f"<{iri}>"

    subjects: dict[str, dict[str, list[str]]] = {}
    for s in statements:
        if s.obj_kind == "iri":
            value = short(s.obj_lexical)
        else:
            value = _literal(s.obj_lexical) + ("" if s.obj_datatype in (None, XSD + "string") else f"^^{short(s.obj_datatype)}")
        subjects.setdefault(s.subject, {}).setdefault(s.predicate, []).append(value)
    out = [f"@prefix {name}: <{space}> .\n" for name, space in namespaces.items()]
    for subject, properties in subjects.items():
        lines = []
        for predicate in sorted(properties, key=lambda p: p != RDF_TYPE):
            lines.append(f"    {'a' if predicate == RDF_TYPE else short(predicate)} {', '.join(properties[predicate])}")
        out.append(f"\n<{subject}>\n" + " ;\n".join(lines) + " .\n")
    return "".join(out)
