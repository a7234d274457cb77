"""The YAML front matter of one document: reading it, and changing it in place.

Changes replace spans of the text, so that whatever else is in the front matter keeps its bytes, comments and order included. After a
change the text is read again; one that YAML's layout doesn't let through (anchors, aliases, document ends) is refused."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

UUID = re.compile("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
#: Fixed limits of tags.
TAG_SIGNS, TAG_BYTES = 40, 80


class Unfit(Exception):
    """A document that breaks a rule; its argument names the rule."""


def _loader():
    import yaml

    class Loader(yaml.SafeLoader):
        """Only true and false are truth values; yes, no, on and off are text."""

    Loader.yaml_implicit_resolvers = {
        sign: [(tag, pattern) for tag, pattern in known if tag != "tag:yaml.org,2002:bool"] for sign, known in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(true|True|TRUE|false|False|FALSE)$"), [*"tTfF"])
    return yaml, Loader


@dataclass
class FrontMatter:
    has_front_matter: bool = False
    has_block: bool = False
    note_id: str | None = None
    schema: int | None = None
    tags: list[str] = field(default_factory=list)
    body: str = ""
    newline: str = "\n"
    opening: str = ""
    yaml: str = ""
    closing: str = ""
    root: object = None
    block: object = None


def split(text: str) -> tuple[str, str, str, str]:
    """(opening line, YAML, closing line, body); the first three are empty without front matter."""
    opening = re.match(r"---\r?\n", text)
    if not opening:
        return "", "", "", text
    closing = re.compile(r"^---\r?(?:\n|\Z)", re.M).search(text, opening.end())
    if not closing:
        raise Unfit("unclosed")
    return opening[0], text[opening.end() : closing.start()], closing[0], text[closing.end() :]


def _pairs(mapping, key: str):
    return next(((k, v) for k, v in mapping.value if not isinstance(k.value, list) and k.value == key), None)


def _kind(node) -> str:
    return node.tag.rsplit(":", 1)[-1]


def _repeats(root) -> bool:
    """Whether a mapping at any depth has a scalar key twice."""
    waiting, known = [root], set()
    while waiting:
        node = waiting.pop()
        if id(node) in known or not isinstance(node.value, list):
            continue
        known.add(id(node))
        keys = set()
        for item in node.value:
            if isinstance(item, tuple):
                key, value = item
                if not isinstance(key.value, list):
                    if (key.tag, key.value) in keys:
                        return True
                    keys.add((key.tag, key.value))
                waiting += [key, value]
            else:
                waiting.append(item)
    return False


def fold(tag: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", tag).casefold())


def tag_fits(tag: str) -> bool:
    return bool(tag) and len(tag) <= TAG_SIGNS and len(tag.encode("utf-8", "surrogatepass")) <= TAG_BYTES and tag == tag.strip() and not any(unicodedata.category(c) == "Cc" for c in tag)


def read(text: str, block: str) -> FrontMatter:
    """What a document's front matter says; Unfit with the first rule it breaks. block is the key of the mapping that holds
    schema, note_id and tags."""
    yaml, loader = _loader()
    opening, inner, closing, body = split(text)
    if not opening:
        return FrontMatter(body=text, newline="\r\n" if "\r\n" in text else "\n")
    out = FrontMatter(True, body=body, newline="\r\n" if "\r" in opening else "\n", opening=opening, yaml=inner, closing=closing)
    if not inner.strip():
        return out
    try:
        root = yaml.compose(inner, Loader=loader)
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        raise Unfit("invalid_yaml") from e
    if not isinstance(root, yaml.MappingNode):
        raise Unfit("invalid_root")
    if _repeats(root):
        raise Unfit("duplicate_key")
    out.root, pair = root, _pairs(root, block)
    if not pair:
        return out
    out.has_block, out.block = True, pair[1]
    if not isinstance(out.block, yaml.MappingNode):
        raise Unfit("invalid_block")
    schema, note_id, tags = (_pairs(out.block, k) for k in ("schema", "note_id", "tags"))
    if not schema:
        raise Unfit("missing_schema")
    value = schema[1].value
    if not isinstance(schema[1], yaml.ScalarNode) or _kind(schema[1]) != "int" or not re.fullmatch("[+-]?[0-9]+", value) or int(value) != 1:
        raise Unfit("unsupported_schema")
    out.schema = 1
    if not note_id:
        raise Unfit("missing_id")
    if not isinstance(note_id[1], yaml.ScalarNode) or _kind(note_id[1]) != "str" or not UUID.fullmatch(note_id[1].value):
        raise Unfit("invalid_id")
    out.note_id = note_id[1].value
    if tags:
        if not isinstance(tags[1], yaml.SequenceNode):
            raise Unfit("invalid_tags")
        for item in tags[1].value:
            known = {fold(t) for t in out.tags}
            if not isinstance(item, yaml.ScalarNode) or _kind(item) != "str" or not unicodedata.is_normalized("NFC", item.value) or not tag_fits(item.value) or fold(item.value) in known:
                raise Unfit("invalid_tags")
            out.tags.append(item.value)
    return out


def _end(node) -> int:
    """Where the last sign of a value lies; a block collection's own mark lies behind the lines after it."""
    if isinstance(node.value, list) and node.value and not node.flow_style:
        last = node.value[-1]
        return _end(last[1] if isinstance(last, tuple) else last)
    return node.end_mark.index


def _data(root) -> object:
    """A node's content, for comparison."""
    if isinstance(root.value, list):
        return [root.tag, *((_data(x[0]), _data(x[1])) if isinstance(x, tuple) else _data(x) for x in root.value)]
    return (root.tag, root.value)


def _with(doc: FrontMatter, mapping, key: str, value: str | None, indent: str) -> str:
    """The YAML with a key of a mapping set to the flow value, or without it if value is None."""
    text, pair = doc.yaml, _pairs(mapping, key)
    at = mapping.value.index(pair) if pair else len(mapping.value)
    if pair and value is not None:
        if pair[1].start_mark.index < pair[0].end_mark.index:
            raise Unfit("unsupported_layout")
        stop = _end(pair[1])
        tail = doc.newline if text[stop - 1 : stop] == "\n" else ""  # a block scalar ends with its line
        return f"{text[: pair[0].end_mark.index]}: {value}{tail}{text[stop:]}"
    if pair:
        start, stop = pair[0].start_mark.index, _end(pair[1])
        if mapping.flow_style:
            if at:
                start = _end(mapping.value[at - 1][1])
            elif len(mapping.value) > 1:
                stop = mapping.value[1][0].start_mark.index
            return text[:start] + text[stop:]
        line = text.rfind("\n", 0, start) + 1
        if text[stop - 1 : stop] != "\n":
            stop = text.find("\n", stop) + 1 or len(text)
        return text[:line] + text[stop:]
    if value is None:
        return text
    last = _end(mapping.value[-1][1]) if mapping.value else None
    if mapping.flow_style:
        if last is None:
            return f"{text[: mapping.end_mark.index - 1]}{key}: {value}{text[mapping.end_mark.index - 1 :]}"
        return f"{text[:last]}, {key}: {value}{text[last:]}"
    if text[last - 1 : last] != "\n":
        last = text.find("\n", last) + 1 or len(text)
    lead = "" if not last or text[last - 1] == "\n" else doc.newline
    return f"{text[:last]}{lead}{indent}{key}: {value}{doc.newline}{text[last:]}"


def _indent(mapping) -> str:
    return " " * mapping.value[0][0].start_mark.column if mapping.value else ""


def _changed(doc: FrontMatter, yaml: str, body: str, block: str, keys: tuple[str, ...]) -> str:
    """The whole text with this YAML; it must say the same but for these keys of the block."""
    opening, closing = doc.opening or f"---{doc.newline}", doc.closing or f"---{doc.newline}"
    if not closing.endswith("\n") and body:
        closing += doc.newline
    text = f"{opening}{yaml}{closing}{body}"
    try:
        again = read(text, block)
    except Unfit as e:
        raise Unfit("unsupported_layout") from e
    def others(d: FrontMatter) -> list:
        out = []
        for k, v in d.root.value if d.root else []:
            if v is d.block:
                out += [(block, _data(x), _data(y)) for x, y in v.value if isinstance(x.value, list) or x.value not in keys]
            else:
                out.append((_data(k), _data(v)))
        return out

    if others(again) != others(doc) or again.body != body:
        raise Unfit("unsupported_layout")
    return text


def quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def with_identity(text: str, candidate: str, block: str) -> tuple[str, str]:
    """(text, id): with a block of this id if there is none; a valid one stays as it is, byte for byte."""
    doc = read(text, block)
    if doc.has_block:
        return text, doc.note_id
    n = doc.newline
    if doc.root is not None and doc.root.flow_style:
        yaml = _with(doc, doc.root, block, f"{{schema: 1, note_id: {quoted(candidate)}}}", "")
    else:
        lead = _indent(doc.root) if doc.root else ""
        yaml = doc.yaml + ("" if not doc.yaml or doc.yaml.endswith("\n") else n) + f"{lead}{block}:{n}{lead}  schema: 1{n}{lead}  note_id: {quoted(candidate)}{n}"
    return _changed(doc, yaml, doc.body, block, ("schema", "note_id")), candidate


def _expected(text: str, expected: str | None, block: str) -> FrontMatter:
    doc = read(text, block)
    if not doc.has_block or doc.note_id != expected:
        raise Unfit("other_id")
    return doc


def with_new_id(text: str, expected: str, new: str, block: str) -> str:
    doc = _expected(text, expected, block)
    if not UUID.fullmatch(new or "") or new == expected:
        raise Unfit("invalid_id")
    return _changed(doc, _with(doc, doc.block, "note_id", quoted(new), ""), doc.body, block, ("note_id",))


def normalised(tags: list[str]) -> list[str]:
    """Tags trimmed and in composed form, the first of those that differ in case only."""
    out: dict[str, str] = {}
    for tag in tags:
        tag = unicodedata.normalize("NFC", tag.strip())
        if not tag_fits(tag):
            raise Unfit("invalid_tags")
        out.setdefault(fold(tag), tag)
    return [*out.values()]


def with_body_and_tags(text: str, expected: str, body: str, tags: list[str], block: str) -> str:
    """Another body and other tags; without tags their key goes. The body takes the line ends of the front matter if these are CRLF."""
    doc = _expected(text, expected, block)
    tags = normalised(tags)
    yaml = _with(doc, doc.block, "tags", f"[{', '.join(map(quoted, tags))}]" if tags else None, _indent(doc.block))
    if doc.newline == "\r\n":
        body = body.replace("\r\n", "\n").replace("\n", "\r\n")
    return _changed(doc, yaml, body, block, ("tags",))


def as_conflict_copy(text: str, expected: str, new: str, origin: dict, block: str) -> str:
    """The document under a new id, with what it was a copy of."""
    doc = _expected(text, expected, block)
    if not UUID.fullmatch(new or "") or not origin["operation_id"] or not origin["reason"] or not origin["original_target"]:
        raise Unfit("invalid_origin")
    if not origin["canonical_revision"] and origin["reason"] not in ("path_collision", "object_missing", "parent_unavailable"):
        raise Unfit("invalid_origin")
    origin = {"original_note_id": expected} | origin
    value = "{" + ", ".join(f"{k}: {quoted(v) if isinstance(v, str) else int(v or 0)}" for k, v in origin.items()) + "}"
    doc.yaml = _with(doc, doc.block, "note_id", quoted(new), "")
    again = read(f"{doc.opening}{doc.yaml}{doc.closing}{doc.body}", block)
    yaml = _with(again, again.block, "conflict", value, _indent(again.block))
    return _changed(again, yaml, doc.body, block, ("note_id", "conflict"))
