"""Bundles: the published expectations over the fixture folder, hashes, links and synchronisation."""

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.errors import InvalidArgument
from loamdex.index import Index
from loamdex.okf import markdown
from loamdex.okf.bundle import PROJECTION, actions, projections, read_bundle, resolve, summary, sync
from loamdex.okf.document import parse_document
from loamdex.okf.rules import actor
from loamdex.okf.yamltree import YamlError, metadata, scalar_kind
from loamdex.schema import Schema

MINIMAL = "---\ntype: Reference\n---\nMinimal conformant concept.\n\n"


@pytest.fixture
def bundle(tmp_path):
    def make(**files):
        root = tmp_path / "bundle"
        for name, text in files.items():
            path = root / name.replace("__", "/").replace("_md", ".md")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(root)

    return make


def codes(spark, root):
    return [(r.path, r.code, r.line, r.column) for r in read_bundle(spark, root).findings.collect()]


CASES = [
    ({"concept_md": MINIMAL}, []),
    ({"concept_md": "no metadata\n"}, [("concept.md", "OKF101", 1, 1)]),
    ({"concept_md": "---\ntitle: x\n---\n"}, [("concept.md", "OKF105", None, None)]),
    ({"concept_md": "---\ntype: [\n---\n"}, "OKF103"),
    ({"concept_md": "---\n- a\n---\n"}, [("concept.md", "OKF104", 2, 1)]),
    ({"concept_md": "---\ntype: a\n"}, [("concept.md", "OKF102", 1, 1)]),
    ({"concept_md": "\ufeff --- \ntype: a\ntype: b\n---\n"}, [("concept.md", "OKF107", 1, 1), ("concept.md", "OKF108", 1, 1), ("concept.md", "OKF106", 3, 1)]),
    ({"concept_md": b"---\n\xff\n---\n"}, [("concept.md", "OKF100", 2, 1)]),
    ({"index_md": "# A\n\ntext\n\n* no link\n"}, [("index.md", "OKF201", 3, 1), ("index.md", "OKF202", 5, 1)]),
    ({"index_md": "---\nokf_version: \"0.2\"\n---\n# A\n\n* [x](c.md) - more\n* [y](c.md)\n\n## B\n- [z](c.md)\n", "c_md": MINIMAL}, []),
    ({"sub__index_md": "---\na: b\n---\n# A\n- [x](../c.md)\n", "c_md": MINIMAL}, [("sub/index.md", "OKF200", 1, 1)]),
    ({"index_md": "---\nokf_version: \"0.3\"\n---\n# A\n- [x](x)\n"}, [("index.md", "OKF207", 2, 14)]),
    ({"index_md": "---\nokf_version: new\n---\n# A\n- [x](x)\n"}, [("index.md", "OKF206", 2, 14)]),
    ({"log_md": "# Log\n\n## yesterday\n\n## 2024-01-31\n"}, [("log.md", "OKF203", 3, 1)]),
    (
        {"concept_md": "---\ntype: A\nstatus: old\nstale_after: soon\ntags: one\ntimestamp: 2024-01-01T00:00:00Z\n---\n\ntext\n\n\n# Citations\n"},
        [("concept.md", "OKF320", 3, 9), ("concept.md", "OKF321", 4, 14), ("concept.md", "OKF330", 5, 7), ("concept.md", "OKF340", 6, 12), ("concept.md", "OKF341", 12, 1)],
    ),
    (
        {"c_md": "---\ntype: A\nsources:\n  - id: a\n    resource: r\n    author: nobody\n    usage_count: -1\n    last_modified: 2024\n  - id: a\n  - text\nusage_window: {from: 2024-02-01, to: 2024-01-01}\ngenerated: {by: agent/x, at: 2024-02-01T00:00:00Z}\nverified:\n  - {by: 'human:me', at: 2024-01-01T00:00:00Z}\n  - {by: x}\n---\n[^a]: fine\n\n[^b]: none\n"},
        [("c.md", "OKF314", 6, 13), ("c.md", "OKF304", 7, 18), ("c.md", "OKF304", 8, 20), ("c.md", "OKF301", 9, 5), ("c.md", "OKF302", 9, 9), ("c.md", "OKF300", 10, 5), ("c.md", "OKF303", 11, 15), ("c.md", "OKF315", 14, 3), ("c.md", "OKF313", 15, 5), ("c.md", "OKF360", 19, 1)],
    ),
    (
        {"c_md": "---\ntype: Attested Computation\nparameters: [{name: a, type: b, required: true}, {name: a}]\ncomputation: gone.py\nexecutor: {resource: 'https://x', receipt: [1]}\nattester: {}\n---\n"},
        [("c.md", "OKF350", 2, 1), ("c.md", "OKF351", 3, 50), ("c.md", "OKF352", 4, 14), ("c.md", "OKF353", 5, 44), ("c.md", "OKF354", 6, 11)],
    ),
    ({"a_md": "---\ntype: A\n---\n[b](b.md) [gone](no.md) [up](../x.md) [bad](a%2Fb.md) <https://x.y> ![i](no.png) `[c](no.md)`\n", "b_md": MINIMAL}, [("a.md", "OKF400", 4, 11), ("a.md", "OKF401", 4, 25), ("a.md", "OKF402", 4, 39)]),
    ({"a_md": MINIMAL, "A_md": MINIMAL}, [("a.md", "OKF204", None, None)]),
]


@pytest.mark.parametrize(("files", "want"), CASES)
def test_findings(spark, bundle, files, want):
    got = codes(spark, bundle(**files))
    if isinstance(want, str):
        assert [c for _, c, *_ in got] == [want]
    else:
        assert got == want


def test_links_make_a_graph(spark, bundle):
    root = bundle(a_md="---\ntype: A\n---\n[b](sub/b.md#x) [again](/sub/b.md?q) [self](a.md) [ref][r]\n\n[r]: sub/b.md\n", sub__b_md="---\ntype: B\n---\n[up](../a.md)\n\n```\n[no](../gone.md)\n```\n")
    found = read_bundle(spark, root)
    assert found.findings.count() == 0
    assert sorted(map(tuple, found.edges.collect())) == [("a.md", "a.md"), ("a.md", "sub/b.md"), ("sub/b.md", "a.md")]
    docs = {r.path: json.loads(r.data_json) for r in projections(found).collect()}
    assert docs["/a"]["link_targets"] == ["/a", "/sub/b"] and docs["/sub/b"]["backlinks"] == ["/a"] and list(docs) == ["/a", "/sub/b"]


def test_published_hashes(spark, bundle, tmp_path):
    root = bundle(minimal_md=MINIMAL)
    doc = json.loads(projections(read_bundle(spark, root)).first().data_json)
    assert doc["okf_projection_hash"] == "5a9029f6032cd0142315610ffc0d2d9d9f6689c638a1b4b30e6d24e857e3a4ab"
    os.remove(f"{root}/minimal.md")
    bundle(x_md="---\ntype: Note\nsources:\n - resource: x\n   usage_count: 0.0000001\n---\nx\n")
    assert projections(read_bundle(spark, root)).first().hash == "c4da14b0d649d845d0fdaac4ff318506ba5bf52841a2f7556d3f27cf2f68a5d3"


def test_sync_follows_the_bundle(spark, bundle, tmp_path):
    root = bundle(a_md=MINIMAL, b_md="---\ntype: Note\ntitle: Bee\ntags: [x, y, x]\nverified: {by: 'human:me', at: 2024-01-01T00:00:00Z}\n---\nSee [a](a.md)\n")
    index = Index.create(spark, str(tmp_path / "t.idx"), PROJECTION)
    report = sync(spark, root, index, dry_run=True)
    assert report["ok"] and report["added"] == 2 and index.items.count() == 0
    assert sync(spark, root, index)["added"] == 2
    assert index.count("trust_tier:human-reviewed AND tags:y AND link_targets:/a") == 1 and index.count("title:bee AND body:see") == 1
    again = sync(spark, root, index)
    assert (again["unchanged"], again["added"], again["updated"], again["deleted"]) == (2, 0, 0, 0)
    bundle(a_md=MINIMAL + "More.\n", c_md=MINIMAL)
    os.remove(f"{root}/b.md")
    assert {r.kind for r in actions(read_bundle(spark, root), index).collect()} == {"add", "update", "delete"}
    third = sync(spark, root, index)
    assert (third["added"], third["updated"], third["deleted"]) == (1, 1, 1)
    bundle(d_md="broken\n")
    assert not sync(spark, root, index)["ok"] and index.items.count() == 2
    os.remove(f"{root}/d.md")
    bundle(d_md="---\ntype: A\nstatus: odd\n---\n")
    assert not sync(spark, root, index, strict=True)["ok"] and sync(spark, root, index)["ok"]
    other = Index.create(spark, str(tmp_path / "o.idx"), Schema.from_spec("a:text"))
    with pytest.raises(InvalidArgument):
        sync(spark, root, other)
    bundle(e_md=MINIMAL)
    os.rename(f"{root}/e.md", f"{root}/a.md.md")
    with pytest.raises(InvalidArgument):
        sync(spark, root, index)


def test_odd_files(spark, bundle, tmp_path):
    root = bundle(a_md=MINIMAL, other_txt="x")
    os.symlink(f"{root}/a.md", f"{root}/link.md")
    found = read_bundle(spark, root, "9.9")
    assert [(r.path, r.code) for r in found.findings.collect()] == [("link.md", "OKF205")]
    assert summary(found) == {"target_version": "9.9", "declared_version": None, "bundle": root, "concepts": 1, "errors": 0, "warnings": 1}
    with pytest.raises(InvalidArgument):
        read_bundle(spark, str(tmp_path / "nowhere"))
    empty = tmp_path / "empty"
    empty.mkdir()
    assert read_bundle(spark, str(empty)).findings.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400) | st.text(alphabet="-:#[]()*`<>!\n ab\"'&|%{}^", max_size=200).map(lambda t: f"---\n{t}\n---\n{t}".encode()))
def test_nothing_breaks_the_parsers(raw):
    doc = parse_document("x.md", raw)
    assert doc.raw == raw
    markdown.links(doc.body or "")
    markdown.blocks(doc.body or "")
    markdown.footnotes(doc.body or "")


def test_scalars_and_aliases():
    kinds = {"yes": "string", "true": "boolean", "null": "null", "~": "null", "12": "integer", "0x1f": "integer", "1.5": "float", "1e-7": "float", "2024-01-01": "timestamp", "2024-1-2": "timestamp", "12-01-01": "string"}
    assert {k: scalar_kind("plain", k) for k in kinds} == kinds
    root, repeated = metadata("a: &x one\nb: *x\nc: !!str 5\nd: '5'\ne: !!int '5'\na: two\n")
    assert [root.text(k) for k in "abcd"] == ["one", "one", "5", "5"] and root.get("e").kind == "integer" and repeated[0][0] == "a"
    with pytest.raises(YamlError):
        metadata("a: 1\n--- \nb: 2\n")


def test_references():
    assert resolve("a/b.md", "c%20d.md") == ("local", "a/c d.md")
    assert resolve("a/b.md", "/x/./y.md#z") == ("local", "x/y.md")
    assert [resolve("b.md", r)[0] for r in ("#x", "mailto:a@b", "//h/x", "../x", "%zz", "a%00")] == ["external", "external", "external", "OKF401", "OKF402", "OKF402"]
    assert [actor(a) for a in ("human:me", "agent/x", "nobody", "a: b", ":x", "")] == [True, True, False, False, False, False]
