"""Front matter: golden documents, and changes that leave everything else as it is."""

import random
import re

import pytest

yaml = pytest.importorskip("yaml")

from changetree.functions import front_matter as fm  # noqa: E402
from changetree.operators import documents as dc  # noqa: E402

ID, NEW = "550e8400-e29b-41d4-a716-446655440000", "018f4c3a-1234-7abc-8123-123456789abc"


def block(*more, id_=f'"{ID}"', schema="1", lead="meta:\n"):
    return f"---\n{lead}  schema: {schema}\n  note_id: {id_}\n{''.join(f'  {x}' + chr(10) for x in more)}---\nBody\n"


GOLDEN = {
    "# Note\n": (False, False, None, None), "": (False, False, None, None), "----\nx\n": (False, False, None, None), " ---\na: 1\n---\n": (False, False, None, None),
    "---\ntitle: Example\n---\nBody\n": (True, False, None, None), "---\n---\n": (True, False, None, None), "---\r\ntitle: x\r\n---\r\nB": (True, False, None, None), "---\n \n---": (True, False, None, None),
    block(): (True, True, ID, None), block("tags: [a, 'b c']"): (True, True, ID, None), block(lead="other: {x: [1, 2]}\nmeta:\n"): (True, True, ID, None),
    "---\ntitle: no end\n": "unclosed", "---\n[broken\n---\n": "invalid_yaml", "---\n- item\n---\n": "invalid_root", "---\ntext\n---\n": "invalid_root", "---\n# only\n---\n": "invalid_root",
    "---\ntitle: one\ntitle: two\n---\n": "duplicate_key", "---\na: {b: [{c: 1, c: 2}]}\n---\n": "duplicate_key", "---\na: 1\n'a': 2\n---\n": "duplicate_key", "---\nmeta: true\n---\n": "invalid_block",
    f'---\nmeta:\n  note_id: "{ID}"\n---\n': "missing_schema", block(schema="2"): "unsupported_schema", block(schema='"1"'): "unsupported_schema", block(schema="0x1"): "unsupported_schema",
    "---\nmeta:\n  schema: 1\n---\n": "missing_id", block(id_="nope"): "invalid_id", block(id_=f'"{ID.upper()}"'): "invalid_id", block(id_='"00000000-0000-0000-0000-000000000000"'): "invalid_id",
    block(id_='"550e8400-e29b-41d4-c716-446655440000"'): "invalid_id", block("tags: a"): "invalid_tags", block("tags: [1]"): "invalid_tags", block("tags: [a, A]"): "invalid_tags",
    block('tags: [" a"]'): "invalid_tags", block(f"tags: [{'x' * 41}]"): "invalid_tags", block('tags: ["e\\u0301"]'): "invalid_tags", block('tags: ["a\\u0007"]'): "invalid_tags",
    "---\n" + "[" * 3000 + "\n---\n": "invalid_yaml", "---\na: 1\n---\n---\nb": (True, False, None, None),
}


def test_golden_documents(spark):
    texts = [*GOLDEN, None]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, text string, problem_of string")
    got = {r.k: r for r in dc.front_matter_extract(docs).collect()}
    assert len(got) == len(texts) and got[len(texts) - 1].has_block is None
    for k, text in enumerate(GOLDEN):
        r, want = got[k], GOLDEN[text]
        if isinstance(want, str):
            assert (r.problem, r.has_front_matter, r.body) == (want, False, None), text
        else:
            assert (r.has_front_matter, r.has_block, r.note_id, r.problem) == want, text
    assert got[texts.index(block("tags: [a, 'b c']"))].tags == ["a", "b c"] and got[texts.index(block())].body == "Body\n"
    assert fm.read(block("tags: [yes, on]"), "meta").tags == ["yes", "on"]


def test_ids_are_assigned_once(spark):
    texts = ["# Note\n\nBody\n", "# Note\r\nBody\r\n", "", "---\ntitle: x # why\n\n---\nB\n", "---\r\ntitle: x\r\n---\r\nB\r\n", "---\n{a: 1}\n---\nB", "---\n  a: 1\n---\n", "---\n---\nB", block(), "---\na: 1\n---", "---\nx\n---\n", None]
    docs = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(texts)], "path string, text string")
    once = dc.assign_document_ids(docs)
    got = {r.path: r for r in once.collect()}
    again = {r.path: r for r in dc.assign_document_ids(once.select("path", "text")).collect()}
    for k, text in enumerate(texts):
        r = got[f"p{k}"]
        if text is None or text == "---\nx\n---\n":
            assert r.text == text and r.problem in ("no_text", "invalid_root") and not r.changed
            continue
        doc = fm.read(r.text, "meta")
        assert r.problem is None and doc.note_id == r.note_id and r.changed == (text != block()), text
        assert (again[f"p{k}"].text, again[f"p{k}"].changed) == (r.text, False)
        assert doc.body == fm.read(text, "meta").body
        if "\r\n" in text:
            assert not re.search("(?<!\r)\n", r.text)
    assert "title: x # why\n\n" in got["p3"].text and got["p8"].text == block()


def test_rewrites_keep_the_rest(spark):
    odd = f"---\n# first\nzeta: [1, 2]  # list\nmeta:\n    schema: 1 # v\n    note_id: '{ID}'   # id\n    tags:\n      - one # a\n      - two\n    extra: |\n      kept\n      lines\n\nalpha: {{x: y}}\n---\nBody\n"
    flow = f'---\nmeta: {{schema: 1, tags: [a], note_id: "{ID}"}}\nq: 1\n---\nBody\n'
    first = f'---\nmeta: {{tags: [a], schema: 1, note_id: "{ID}"}}\n---\nBody\n'
    last = f'---\nmeta:\n  schema: 1\n  note_id: "{ID}"\n  tags: [a]\n---'
    crlf = block("tags:", "- a", "- b").replace("\n", "\r\n")
    anchored = f'---\nid: &i "{ID}"\nmeta: {{schema: 1, note_id: *i}}\n---\n'
    docs = spark.createDataFrame([*{"odd": odd, "flow": flow, "first": first, "last": last, "crlf": crlf, "none": "# Note\n", "plain": block(), "anchored": anchored}.items()], "path string, text string")
    names = [r.path for r in docs.collect()] + ["gone"]
    rekey = spark.createDataFrame([(n, ID, NEW) for n in names], "path string, expected_id string, new_id string")
    got = {r.path: r for r in dc.rewrite_front_matter(docs, rekey, "rekey").collect()}
    texts = {r.path: r.text for r in docs.collect()}
    for n in ("odd", "flow", "first", "last", "crlf", "plain"):
        assert got[n].text == re.sub(f"['\"]{ID}['\"]", f'"{NEW}"', texts[n]), n
    assert (got["none"].problem, got["gone"].problem, got["anchored"].problem) == ("other_id", "no_text", "unsupported_layout") and got["none"].text == "# Note\n"
    edit = lambda body, tags: {
        r.path: r for r in dc.rewrite_front_matter(docs, spark.createDataFrame([(n, ID, body, tags) for n in names], "path string, expected_id string, new_body string, new_tags array<string>"), "replace").collect()
    }
    more = edit("New\nbody", [" Ä", "ä", 'say "x"'])
    assert more["odd"].text == odd.replace("tags:\n      - one # a\n      - two", 'tags: ["Ä", "say \\"x\\""]').replace("Body\n", "New\nbody")
    assert more["flow"].text == flow.replace("[a]", '["Ä", "say \\"x\\""]').replace("Body\n", "New\nbody")
    assert more["plain"].text == block('tags: ["Ä", "say \\"x\\""]').replace("Body\n", "New\nbody")
    assert more["crlf"].text.endswith("New\r\nbody") and not re.search("(?<!\r)\n", more["crlf"].text)
    none = edit("", [])
    assert none["odd"].text == odd.replace("    tags:\n      - one # a\n      - two\n", "").replace("Body\n", "")
    assert none["flow"].text == flow.replace(", tags: [a]", "").replace("Body\n", "") and none["first"].text == first.replace("tags: [a], ", "").replace("Body\n", "")
    assert none["last"].text == last.replace("  tags: [a]\n", "") and fm.read(none["crlf"].text, "meta").tags == []
    assert {r.problem for r in edit("", ["x" * 41]).values()} == {"invalid_tags", "other_id", "no_text"}


def test_conflict_copies(spark):
    text = block("tags: [a]", "extra: {deep: [1]}")
    docs = spark.createDataFrame([("p", text), ("q", "no front matter")], "path string, text string")
    rows = [("p", ID, NEW, "op", "base_revision_mismatch", 'dir/"N".md', 3, 4), ("q", ID, NEW, "op", "path_collision", "t", None, None), ("p", ID, NEW, "op", "object_deleted", "t", 1, None), ("p", NEW, ID, "op", "x", "t", 1, 1)]
    conflicts = spark.createDataFrame(rows, "path string, expected_id string, new_id string, operation_id string, reason string, original_target string, base_revision long, canonical_revision long")
    got = sorted(((r.problem or "", r.text) for r in dc.conflict_copies(docs, conflicts).collect()))
    assert [p for p, _ in got] == ["", "invalid_origin", "other_id", "other_id"]
    copy = got[0][1]
    assert copy.startswith(text[: text.index('"')]) and copy.endswith("---\nBody\n") and "  tags: [a]\n  extra: {deep: [1]}\n" in copy
    meta = yaml.safe_load(copy.split("---")[1])["meta"]
    assert meta["note_id"] == NEW and meta["conflict"] == {"original_note_id": ID, "operation_id": "op", "reason": "base_revision_mismatch", "original_target": 'dir/"N".md', "base_revision": 3, "canonical_revision": 4}


def test_random_documents_keep_their_data():
    """Whatever the front matter holds, a change of tags and a new id change nothing else, or are refused."""
    rng, refused = random.Random(6), 0

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        if kind == 5:
            return {f"k{j}": value(depth - 1) for j in range(rng.randrange(3))}
        return [rng.randrange(99), "text with: colon", "line\nline two\n", "# no comment"][kind]

    for _ in range(300):
        meta = {"schema": 1, "note_id": ID} | ({"tags": ["a", "b"]} if rng.random() < 0.5 else {}) | {f"m{j}": value(2) for j in range(rng.randrange(3))}
        root = {f"r{j}": value(2) for j in range(rng.randrange(3))} | {"meta": dict(rng.sample([*meta.items()], len(meta)))}
        text = "---\n" + yaml.safe_dump(root, default_flow_style=rng.choice([None, False, True]), sort_keys=False, width=10**6) + "---\nBody\n"
        tags = rng.choice([[], ["x"], ["x", "y: z"]])
        try:
            out = fm.with_new_id(fm.with_body_and_tags(text, ID, "B", tags, "meta"), ID, NEW, "meta")
        except fm.Unfit as e:
            assert str(e) == "unsupported_layout", text
            refused += 1
            continue
        want = dict(root, meta={k: v for k, v in (root["meta"] | {"note_id": NEW}).items() if k != "tags"} | ({"tags": tags} if tags else {}))
        assert yaml.safe_load(out.split("---")[1]) == want and out.endswith("---\nB"), text
    assert refused < 15
