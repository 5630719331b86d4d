"""Whole trees: a clean library, and one service with each bad call beside its safe form."""

import pytest

from strataq.plans.analyse import analyse, write

README = "# Tool\n" + "word " * 200

CLEAN = {
    "README.md": README, "LICENSE": "MIT", "pyproject.toml": '[project]\nname = "lib"\ndependencies = ["rich==13.0.0"]\n', "poetry.lock": '[[package]]\nname = "rich"\nversion = "13.0.0"\n',
    "lib/__init__.py": "", "lib/core.py": '"""Core."""\n\n\ndef add(a, b):\n    return a + b\n', "tests/test_core.py": "from lib.core import add\n\n\ndef test_add():\n    assert add(1, 2) == 3\n", ".github/workflows/ci.yml": "run: pytest\n",
}
SERVICE = {
    "app/main.py": "from fastapi import FastAPI\nfrom app.db import run\nimport json\napp = FastAPI()\n\n\n@app.post('/items')\ndef add(body):\n    data = request.json()\n    return run(data)\n",
    "app/db.py": "import subprocess\nfrom app.main import app\n\n\ndef run(cmd):\n    subprocess.run(cmd, shell=True)\n    subprocess.run(['ls'])\n    cur.execute(f'SELECT * FROM t WHERE id={cmd}')\n    cur.execute('SELECT * FROM t WHERE id=%s', (cmd,))\n    password = \"h8Kq2pLw9z\"\n    return app\n",
    "web/a.ts": "import { b } from './b';\nexport const a = () => b();\n", "web/b.ts": "import { a } from './a';\nexport const b = () => { eval(a); };\n",
    "db/schema.sql": "CREATE TABLE t (id int PRIMARY KEY, u int REFERENCES v(id));\n", "requirements.txt": "flask>=1.0\nrich\n", "package.json": '{"dependencies": {"left": "^1.0.0"}}', ".env": "API_TOKEN=q8w7e6r5t4\n", "docs/x.md": "[gone](./none.md)\n",
}


@pytest.fixture
def tree(tmp_path):
    def build(content):
        for path, text in content.items():
            f = tmp_path / "repo" / path
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(text)
        return str(tmp_path / "repo")

    return build


def test_clean_library(spark, tree, tmp_path):
    t = analyse(spark, tree(CLEAN))
    assert [tuple(r) for r in t["findings"].select("rule_id", "path").collect()] == []
    assert t["health"].first()["grade"] == "A"
    write(t, str(tmp_path / "out"), "a1")
    write(t, str(tmp_path / "out"), "a1")
    assert spark.read.parquet(str(tmp_path / "out" / "files")).count() == len(CLEAN)


def test_service(spark, tree):
    advisories = spark.createDataFrame([("A-1", "PyPI", "flask", "0", "2.0", "HIGH")], "id string, ecosystem string, name string, introduced string, fixed string, severity string")
    t = analyse(spark, tree(SERVICE), advisories)
    got = {(r["rule_id"], r["path"]) for r in t["findings"].collect()}
    for want in [
        ("injection/os-command", "app/db.py"), ("injection/sql", "app/db.py"), ("secret/hardcoded-credential", "app/db.py"), ("dead-code/unused-import", "app/main.py"), ("api/unauthenticated-mutation", "app/main.py"), ("api/missing-input-validation", "app/main.py"),
        ("injection/dynamic-code-execution", "web/b.ts"), ("architecture/circular-dependency", "web/a.ts"), ("architecture/circular-dependency", "app/db.py"), ("database/unindexed-foreign-key", "db/schema.sql"), ("dependency/unpinned-version", "requirements.txt"), ("dependency/missing-lockfile", "package.json"),
        ("secret/committed-env-file", ".env"), ("documentation/missing-readme", None), ("documentation/missing-license", None), ("documentation/broken-link", "docs/x.md"),
    ]:
        assert want in got, want
    assert t["findings"].where("rule_id = 'injection/os-command'").count() == 1 and t["findings"].where("rule_id = 'injection/sql'").count() == 1
    assert t["findings"].select("fingerprint").distinct().count() == t["findings"].count()
    assert t["health"].first()["score"] <= 69


def _block(n):
    return "\n".join(f"  const v{i} = f{i}(a, {i}) + g{i}(b);" for i in range(n))


def test_copies_and_flags_of_a_tree(spark, tree):
    """Copied blocks are found and cost points; specification, rate limit and test script are read from the tree."""
    routes = "import express from 'express';\nconst app = express();\n" + "".join(f"app.get('/r{i}', h);\n" for i in range(12)) + "app.post('/login', h);\n"
    py = "def f(a):\n" + "".join(f"    x{i} = g{i}(a, {i})  # note\n" for i in range(12)) + "    return x0\n"
    base = {
        "web/a.ts": f"export function one(a, b) {{\n{_block(40)}\n}}\n", "web/b.ts": f"// other\nexport function two(a, b) {{\n{_block(40)}\n}}\n", "web/server.ts": routes,
        "lib/p.py": py, "lib/q.py": "import os\n\n\n" + py, "web/a.test.ts": "it('a', f);\n", "package.json": '{"scripts": {"test": "echo no test specified"}}',
    }
    t = analyse(spark, tree(base))
    rows = t["findings"].collect()
    got = {(r["rule_id"], r["path"], r["severity"]) for r in rows}
    assert {x for x in got if x[0] == "duplication/duplicate-block"} == {("duplication/duplicate-block", "web/b.ts", "MEDIUM"), ("duplication/duplicate-block", "lib/q.py", "LOW")}
    rules = {r["rule_id"] for r in rows}
    assert {"api/no-specification", "api/auth-without-rate-limit", "testing/no-test-script"} <= rules
    score = t["health"].first()["score"]
    fixed = {"web/b.ts": "export const two = 2;\n", "lib/q.py": "import os\n\nprint(os)\n", "openapi.yaml": "openapi: 3.0.0\n", "package.json": '{"scripts": {"test": "vitest"}, "dependencies": {"express-rate-limit": "7.0.0"}}'}
    better = analyse(spark, tree(base | fixed))
    rules = {r["rule_id"] for r in better["findings"].collect()}
    assert not rules & {"duplication/duplicate-block", "api/no-specification", "api/auth-without-rate-limit", "testing/no-test-script"}
    assert better["health"].first()["score"] > score
