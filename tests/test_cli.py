"""The command line: exit codes, one JSON document, warnings; what an index refuses; edits of referrers only."""

import io
import json
import os
import shutil

import pytest

from notemill import cli
from notemill.errors import NoIndexError
from notemill.plans import generation
from notemill.plans.vault import Vault

from .test_links_vault import put


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cli") / "vault")
    os.makedirs(root)
    Vault.init(root)
    put(root, "a/Alpha.md", "﻿---\ntitle: Alpha note\ntags: [x]\nsee: '[[Beta]]'\n---\nwords about kilns and [[Beta#top|b]] ![[Beta^id]] [t](Beta.md) [[Beta]]\n")
    put(root, "a/Beta.md", "---\n: [\n---\n# Beta\nself [[beta]] kiln kiln\n")
    put(root, "c.md", "nothing of interest [[ghost]]\n")
    Vault(spark, root).index()
    return root


def call(spark, root, *argv, ask=None):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main(["--vault", root, "--json", *argv], out, err, spark, ask or (lambda _: ""))
    return code, json.loads(out.getvalue()) if out.getvalue() else None, err.getvalue()


def test_queries(spark, built):
    code, found, err = call(spark, built, "search", "kilns", "--limit", "5")
    assert code == 0 and err == "" and found["query"] == "kilns" and found["terms"] == ["kiln"] and found["stale"] is False
    assert [h["path"] for h in found["hits"]] == ["a/Beta.md", "a/Alpha.md"] and found["hits"][0]["matchedTerms"] == ["kiln"]
    code, found, err = call(spark, built, "search", "the of")
    assert code == 0 and found["hits"] == [] and "nothing to match on" in err
    assert call(spark, built, "links", "--to", "beta")[1]["backlinks"] == [{"path": "a/Alpha.md", "title": "Alpha note"}, {"path": "a/Beta.md", "title": "Beta"}]
    assert [x["resolvedPath"] for x in call(spark, built, "links", "--from", "alpha note")[1]["links"]] == ["a/Beta.md"] * 4
    assert call(spark, built, "links", "--broken")[1]["broken"][-1] == {"target": "ghost", "referrers": ["c.md"]}
    code, report, _ = call(spark, built, "doctor")
    assert report["malformedFrontmatter"] == ["a/Beta.md"] and report["frontmatterLinks"] == ["a/Alpha.md"] and report["orphans"] == []
    assert call(spark, built, "attrs", "--key", "Tags")[1]["keys"] == [{"key": "tags", "occurrences": 1, "distinctValues": 1, "truncated": False, "values": [{"value": "x", "notes": 1}]}]
    assert call(spark, built, "similar", "c")[1]["hits"] == []
    status = call(spark, built, "status")[1]
    assert status["indexPresent"] is True and status["docCount"] == 3 and status["stale"] is False


def test_exit_codes(spark, built, tmp_path):
    assert call(spark, built, "links", "--to", "no such note")[0] == 1
    assert call(spark, built, "links")[0] == 2 and call(spark, built, "links", "--to", "a", "--broken")[0] == 2
    assert call(spark, built, "search")[0] == 2 and call(spark, built, "nonsense")[0] == 2 and call(spark, built, "search", "x", "--filter", "novalue")[0] == 2
    assert call(spark, str(tmp_path), "status")[0] == 3
    assert call(spark, built, "version") == (0, {"version": Vault.version()}, "")
    assert call(spark, str(tmp_path), "init", str(tmp_path / "new"))[0] == 0
    code, status, _ = call(spark, str(tmp_path / "new"), "status")
    assert code == 0 and status["indexPresent"] is False and call(spark, str(tmp_path / "new"), "search", "x")[0] == 3
    assert call(spark, built, "rm", "c", ask=lambda _: "n")[0] == 1 and os.path.exists(os.path.join(built, "c.md"))


def test_point_reads(spark, built):
    t = Vault(spark, built).tables()
    assert generation.document_of(t, "a/Beta.md")["title"] == "Beta" and generation.document_of(t, "x.md") is None
    assert generation.document_frequency_of(t, "kiln") == 2 and generation.document_frequency_of(t, "unknown") == 0
    assert [r["path"] for r in generation.all_documents(t).collect()] == ["a/Alpha.md", "a/Beta.md", "c.md"]


def test_damaged_indexes_are_refused(spark, built, tmp_path):
    at = str(tmp_path / "index")
    shutil.copytree(os.path.join(built, ".notemill", "index"), at)
    gen = generation.current(at)
    generation.open_index(spark, at)
    part = next(f for f in sorted(os.listdir(os.path.join(gen, "docs"))) if f.endswith(".parquet"))
    with open(os.path.join(gen, "docs", part), "r+b") as f:
        f.truncate(10)
    with pytest.raises(NoIndexError, match="docs"):
        generation.open_index(spark, at)
    shutil.rmtree(os.path.join(gen, "docs"))
    with pytest.raises(NoIndexError, match="docs"):
        generation.open_index(spark, at)
    with open(os.path.join(gen, generation.MANIFEST), "w") as f:
        f.write('{"format_version": 1, "tables": {}}')
    with pytest.raises(NoIndexError, match="format 1"):
        generation.open_index(spark, at)


def test_changes_touch_referrers_of_the_index_only(spark, built):
    put(built, "new.md", "[[Beta]] is not known as a referrer\n")
    code, _, err = call(spark, built, "rename", "beta", "Gamma")
    assert code == 3 and "stale" in err
    code, plan, _ = call(spark, built, "rename", "beta", "Gamma", "--force", "--dry-run")
    assert code == 0 and plan["to"] == "a/Gamma.md" and plan["dryRun"] and {e["path"] for e in plan["edits"]} == {"a/Alpha.md", "a/Beta.md"}
    os.rename(os.path.join(built, "a/Beta.md"), os.path.join(built, "away"))
    assert call(spark, built, "rename", "beta", "Gamma", "--force", "--dry-run")[1]["unresolved"] == {"a/Beta.md": "file no longer exists"}
    os.rename(os.path.join(built, "away"), os.path.join(built, "a/Beta.md"))
    code, plan, err = call(spark, built, "rename", "beta", "Gamma", "--force")
    assert code == 0 and "stale" in err and plan["fileCount"] == 2
    with open(os.path.join(built, "a/Alpha.md"), encoding="utf-8") as f:
        text = f.read()
    assert text.startswith("﻿---\n") and "[[Gamma#top|b]] ![[Gamma" in text and "[[Gamma]]" in text
    with open(os.path.join(built, "new.md")) as f:
        assert f.read().startswith("[[Beta]]")
    with open(os.path.join(built, "a/Gamma.md")) as f:
        assert "self [[Gamma]]" in f.read()
    Vault(spark, built).index()
    code, plan, _ = call(spark, built, "rm", "c", "--yes")
    assert code == 0 and not os.path.exists(os.path.join(built, "c.md"))
