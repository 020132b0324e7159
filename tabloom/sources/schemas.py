"""Schemas of documents bound to what a table offers.

JSON Schema and XSD are read into one kind of tree: nodes with a name, whether they must be there,
whether they repeat, and what is inside. Nodes open lazily, so that parts which no column or nest
fills may be of any form. One pass, bind(), then matches a tree with the columns and nests by name
and gives a shape, which documents.py turns into text.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from tabloom.plans.spec import Plan

#: Groups inside each other that a schema may have; only a recursive one has more.
DEEPEST = 64
_X = {"x": "http://www.w3.org/2001/XMLSchema"}


class DocumentError(Exception):
    """A document that can't be shaped or found; the message names the table."""


# --- shapes --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    column: str
    required: bool = False
    type: str | None = None


@dataclass(frozen=True)
class Group:
    """An object or element with named parts."""

    parts: tuple[tuple[str, Leaf | Group | Many], ...]
    required: bool = False


@dataclass(frozen=True)
class Many:
    """Nested child records; container: the element around them (XML), item: the element of each."""

    column: str
    each: Leaf | Group
    container: str | None = None
    item: str | None = None


Shape = Leaf | Group | Many


@dataclass(frozen=True)
class Names:
    """What a record offers: its columns, and for each nested collection the names inside."""

    columns: tuple[str, ...]
    nests: dict[str, Names]


# --- the tree ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A named place of a schema. opened() lists the places inside, None for a scalar. An element
    (XML) that may repeat can also stand once; an array can't."""

    name: str
    path: str
    opened: Callable[[], list[Node] | None]
    needed: bool = True
    repeats: bool = False
    element: bool = False
    type: str | None = None


@dataclass(frozen=True)
class Binder:
    """Matches nodes with names; where tells what the messages are about."""

    where: str

    def fail(self, text: str) -> DocumentError:
        return DocumentError(f"{self.where}: {text}")

    def records(self, node: Node, names: Names, level: int = 0) -> Group:
        """The shape of one record of node."""
        inside = node.opened()
        if inside is None:
            raise self.fail(f"{node.path or 'the schema'} describes a single value where records are due")
        if level > DEEPEST:
            raise self.fail(f"more than {DEEPEST} levels at {node.path}; a recursive schema can't be filled")
        found = [(n.name, self.bind(n, names, level + 1)) for n in inside]
        return Group(tuple((k, s) for k, s in found if s is not None), node.needed)

    def bind(self, node: Node, names: Names, level: int = 0) -> Shape | None:
        """What of node the names can fill; None if it is left out, an error if it can't be."""
        if node.name in names.nests and (node.repeats or node.element):
            return self._nest(node, names.nests[node.name], level)
        if node.element or not node.repeats:
            if node.opened() is not None:
                return self.records(node, names, level)
            if node.name in names.columns:
                return Leaf(node.name, node.needed, node.type)
        if node.needed:
            raise self.fail(f"{node.path} is required, but no {'nest' if node.repeats else 'column'} of the table has its name")
        return None

    def _nest(self, node: Node, names: Names, level: int) -> Many:
        inside = [] if node.repeats else node.opened() or []
        repeated = node if node.repeats else inside[0] if len(inside) == 1 and inside[0].repeats else None
        if repeated is None:
            raise self.fail(f"{node.path} has the name of a nest, but neither repeats nor holds one element that does")
        each = Group(self.records(repeated, names, level).parts, True)
        return Many(node.name, each, None if repeated is node else node.name, repeated.name)


def schema_path(plan: Plan, file: str, table: str) -> Path:
    """Relative schema files stand beside the plan."""
    path = (plan.base_dir or Path()) / file
    if not path.exists():
        raise DocumentError(f"tables.{table}.format: no schema file at {path}")
    return path


# --- JSON Schema ---------------------------------------------------------------------------


class JsonReader:
    """Nodes of JSON Schema files, which refer to each other by file name or $id."""

    def __init__(self, plan: Plan, files: tuple[str, ...], table: str):
        self.binder = Binder(f"tables.{table}.format")
        paths = [schema_path(plan, f, table) for f in files]
        self.docs: dict[str, Any] = {p.name: json.loads(p.read_text()) for p in paths}
        self.main = paths[0].name
        self.ids = {doc["$id"]: name for name, doc in self.docs.items() if isinstance(doc, dict) and "$id" in doc}

    def _home(self, file: str, here: str) -> str:
        """The document that the part of a reference before # means."""
        for name in (self.ids.get(file), file, Path(file).name) if file else (here,):
            if name in self.docs:
                return name
        raise self.binder.fail(f"$ref to {file!r}, which is none of the schema files")

    def _target(self, ref: str, here: str) -> tuple[Any, str]:
        file, _, pointer = ref.partition("#")
        home = self._home(file, here)
        keys = [k.replace("~1", "/").replace("~0", "~") for k in pointer.split("/")[1:] if pointer != "/"]
        try:
            return reduce(lambda at, k: at[int(k)] if isinstance(at, list) else at[k], keys, self.docs[home]), home
        except (LookupError, TypeError, ValueError):
            raise self.binder.fail(f"$ref {ref!r} points at nothing") from None

    def settled(self, raw: Any, here: str, path: str) -> tuple[dict, str]:
        """raw with its references followed, and the document that this leads to."""
        passed: list[tuple[str, str]] = []
        while isinstance(raw, dict) and "$ref" in raw:
            if (here, raw["$ref"]) in passed:
                raise self.binder.fail(f"circular $ref {raw['$ref']!r} at {path or 'the top'}")
            passed.append((here, raw["$ref"]))
            raw, here = self._target(raw["$ref"], here)
        return raw if isinstance(raw, dict) else {}, here

    def node(self, name: str, path: str, raw: Any, here: str, needed: bool = True) -> Node:
        schema, here = self.settled(raw, here, path)
        kinds = schema.get("type")
        kind = kinds if isinstance(kinds, str) else next((k for k in kinds or () if k != "null"), None)
        if name and (kinds == "array" or "items" in schema):
            return Node(name, path, lambda: self.node("", f"{path}[]", schema.get("items", {}), here).opened(), needed, True)
        if "properties" not in schema and kinds != "object":
            return Node(name, path, lambda: None, needed, type=kind)
        musts, props = schema.get("required") or (), schema.get("properties") or {}
        prefix = f"{path}." if path else ""
        return Node(name, path, lambda: [self.node(k, prefix + k, v, here, k in musts) for k, v in props.items()], needed)

    def record(self, names: Names) -> Shape:
        """The shape of a record: the first file's schema, or of its items if it is an array."""
        top = self.docs[self.main]
        items = top.get("items", {}) if isinstance(top, dict) and top.get("type") == "array" else top
        return self.binder.records(self.node("", "", items, self.main), names)


# --- XSD -----------------------------------------------------------------------------------


def _plain(name: str | None) -> str:
    """A name without its prefix."""
    return (name or "").rpartition(":")[2]


class XsdReader:
    """Nodes of XSD files and of all that they include or import."""

    def __init__(self, plan: Plan, files: tuple[str, ...], table: str):
        self.table, self.binder = table, Binder(f"tables.{table}.format")
        roots: dict[Path, ET.Element] = {}
        for f in files:
            self._load(schema_path(plan, f, table).resolve(), roots)
        named = lambda tag: {el.get("name"): el for root in roots.values() for el in root.findall(f"x:{tag}", _X)}
        self.elements, self.types = named("element"), named("complexType")

    def _load(self, path: Path, roots: dict[Path, ET.Element]) -> None:
        if path in roots:
            return
        if not path.exists():
            raise self.binder.fail(f"a schema includes {path}, which is not there")
        roots[path] = root = ET.parse(path).getroot()
        for other in root.findall("x:include[@schemaLocation]", _X) + root.findall("x:import[@schemaLocation]", _X):
            self._load((path.parent / other.get("schemaLocation")).resolve(), roots)

    def node(self, particle: ET.Element, above: str = "") -> Node:
        """particle: a declaration, or a reference to a global one with its own occurrence."""
        ref = _plain(particle.get("ref"))
        if ref and ref not in self.elements:
            raise self.binder.fail(f"{above or 'the schema'} refers to the element {ref}, which is declared nowhere")
        el = self.elements[ref] if ref else particle
        path = "/".join(filter(None, (above, el.get("name"))))
        occurs = {**el.attrib, **particle.attrib}
        return Node(el.get("name"), path, lambda: self._inside(el, path), occurs.get("minOccurs") != "0", particle.get("maxOccurs") == "unbounded", True)

    def _inside(self, el: ET.Element, path: str) -> list[Node] | None:
        kind = el.find("x:complexType", _X)
        kind = self.types.get(_plain(el.get("type"))) if kind is None else kind
        if kind is None:
            return None
        held = next((x for x in (kind.find("x:sequence", _X), kind.find("x:all", _X)) if x is not None), kind)
        return [self.node(p, path) for p in held.findall("x:element", _X)] if held is not kind else []

    def record(self, record: str | None, wrapper: str) -> tuple[Node, str | None]:
        """A record's node, and the wrapper's name if that is how it was found: the element named so;
        the one that alone repeats in the wrapper; the only one there is."""
        if record and record not in self.elements:
            raise DocumentError(f"tables.{self.table}.format.record: the schemas declare no element {record}")
        if record:
            return self.node(self.elements[record]), None
        around = self.node(self.elements[wrapper]).opened() if wrapper in self.elements else None
        if around and len(around) == 1 and around[0].repeats:
            return around[0], wrapper
        if len(self.elements) != 1:
            raise self.binder.fail("several elements could be the record; name it in format.record")
        return self.node(*self.elements.values()), None

    def content(self, node: Node, names: Names) -> Group:
        return Group(self.binder.records(node, names).parts, True)
