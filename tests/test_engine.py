"""Index a small repository end to end; incremental runs equal full ones."""

import json

import pytest

from factloom.engine import Engine
from factloom.sources import configs, extract, yamlite

FILES = {
    "app/__init__.py": "",
    "app/store.py": 'import os\nDB = os.environ["DB_URL"]\nclass Store:\n    def save(self, x):\n        """Save one."""\n        self.check(x)\n        db.execute("INSERT INTO items VALUES (1)")\n    def check(self, x):\n        return x\n',
    "app/main.py": 'from app.store import Store\n@app.route("/items", methods=["POST"])\ndef create_item():\n    return helper()\ndef helper():\n    return Store().save(1)\n',
    "app/tests/test_store.py": "from app.store import Store\ndef test_save_item():\n    Store().save(2)\n",
    "web/api.ts": "import { x } from './util'\nexport class Api {\n  load(id: string): void {\n    x(id)\n  }\n}\nrouter.get('/things', h)\nconst u = process.env.API_URL\n",
    "web/util.ts": "export function x(id: string) { return id }\n",
    "docker-compose.yml": "services:\n  api:\n    build: .\n    depends_on:\n      - db\n  db:\n    image: postgres:16\n",
    ".env": "API_KEY=sk-secret\nPORT=80 # comment\n",
    "skip/big.bin": "x",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def edges(e):
    return {(r["subject"], r["predicate"], r["object"], r["provenance"]) for r in e.table("edges").collect()}


def test_index_and_queries(spark, repo, tmp_path):
    e = Engine(spark, str(tmp_path / "facts"))
    changes = {r["path"]: r["change"] for r in e.index(str(repo)).collect()}
    assert set(changes) == set(FILES) - {"skip/big.bin"}
    got = edges(e)
    assert ("symbol:app/main.py#create_item", "calls", "symbol:app/main.py#helper", "RESOLVED") in got
    assert ("symbol:app/store.py#Store.save", "calls", "symbol:app/store.py#Store.check", "RESOLVED") in got
    assert ("symbol:app/store.py#Store.save", "writes", "store:items", "EXTRACTED") in got
    assert ("file:web/api.ts", "imports", "file:web/util.ts", "RESOLVED") in got
    assert ("deployment_unit:api", "depends_on", "deployment_unit:db", "DECLARED") in got
    ids = {r["id"] for r in e.table("entities").collect()}
    assert {"secret_reference:API_KEY", "configuration:PORT", "route:app/main.py#POST /items", "test:app/tests/test_store.py#test_save_item"} <= ids
    assert "sk-secret" not in json.dumps([r.asDict() for r in e.table("entities").collect()])
    assert e.verify().filter("kind = 'dangling'").count() == 0
    assert e.search("save item").first()["name"] in ("save", "create_item", "test_save_item")
    assert e.ci_check().first()["passed"]
    (repo / "app/main.py").write_text(FILES["app/main.py"] + "def extra():\n    helper()\n")
    changed = {r["path"] for r in e.index(str(repo), incremental=True).filter("change <> 'same'").collect()}
    assert changed == {"app/main.py"}
    full = Engine(spark, str(tmp_path / "full"))
    full.index(str(repo))
    assert edges(e) == edges(full)


def test_readers_do_not_fail():
    for text in ("", "{", "a: [", "services: 3", "\x00", "- - -"):
        for read in (configs.read_compose, configs.read_k8s, configs.read_github_actions, configs.read_dockerfile, configs.read_env, configs.read_terraform):
            try:
                read("x", text)
            except (ValueError, AttributeError, TypeError, KeyError):
                pass
        for lang in ("python", "typescript", "go", "java", "rust"):
            extract.extract("p", lang, text)


def test_kubernetes_documents():
    text = "apiVersion: v1\nkind: Deployment\nmetadata:\n  name: api\n  namespace: prod\nspec:\n  replicas: 2\n  template:\n    spec:\n      containers:\n        - name: c\n          image: img:1\n          env:\n            - name: TOKEN\n              value: secret\n---\nkind: Secret\nmetadata:\n  name: s\ndata:\n  key: abc\n"
    facts = configs.read_k8s("k.yaml", text)
    assert ("deployment_unit", "api", "deployed_in", "prod", "{}") in facts
    assert json.loads(facts[0][4]) == {"env": ["TOKEN"], "image": "img:1", "namespace": "prod", "replicas": 2}
    assert "secret\"" not in str(facts) and "abc" not in str(facts)


def test_yaml_subset():
    assert yamlite.documents("a: 1\nb:\n  - x: 1\n    y: two\n  - z\nc: [1, 'q']\n") == [{"a": 1, "b": [{"x": 1, "y": "two"}, "z"], "c": [1, "q"]}]


def test_signatures():
    s = extract.parse_signature("def f(a, *args: int, b: dict[str, int] = {}) -> list[int]")
    assert s["name"] == "f" and s["returns"] == "list[int]" and [p["name"] for p in s["params"]] == ["a", "args", "b"]
    assert extract.parse_signature("fn run<T>(&self, x: Vec<(u32, T)>) -> Result<(), E> {")["params"][0]["receiver"]


def test_state_is_replaced_merged_and_emptied(spark, tmp_path):
    from factloom.operators.state import SCHEMAS, State

    s = State(spark, str(tmp_path / "state"))
    assert s.meta_get("a") is None and s.read("flows").count() == 0
    for v in ("1", "2", "3"):
        s.meta_set("a", v)
    s.meta_set("b", "x")
    assert s.meta_get("a") == "3" and s.meta_get("b") == "x" and len(s._versions("meta")) <= 2
    rows = spark.createDataFrame([("k", "high", "m"), ("k", "low", "m"), ("k", "low", "n")], "kind string, severity string, message string")
    s.add_findings(rows)
    s.add_findings(rows)
    assert s.read("drift").count() == 2
    before = s.epoch()
    s.replace_intent_claims(spark.createDataFrame([("component", "{}")], SCHEMAS["intent_claims"]))
    assert s.epoch() != before
    s.merge("embeddings", spark.createDataFrame([("e", [1.0, 2.0], "m")], SCHEMAS["embeddings"]), ["id"])
    ran = []
    assert s.migrate({1: lambda _: ran.append(1), 2: lambda _: ran.append(2)}) == 2 and s.migrate({2: lambda _: ran.append(2), 3: lambda _: ran.append(3)}) == 3 and ran == [1, 2, 3]
    s.purge()
    assert s.read("drift").count() == 0 and s.read("embeddings").count() == 1 and s.meta_get("b") == "x"


def test_ranked_context(spark, repo, tmp_path):
    e = Engine(spark, str(tmp_path / "facts"))
    e.index(str(repo))
    got = e.recompile()
    assert got["components"] >= 2 and got["flows"] >= 1
    flow = e.state.read("flows").filter("entrypoint = 'symbol:app/main.py#create_item'").first()
    assert flow["trigger"].startswith("route:") and {"create_item", "helper", "save"} <= {s["operation"] for s in flow["steps"]}
    rows = e.task("save an item", files=["web/util.ts"], budget=400).collect()
    assert {r["path"] for r in rows if r["required"]} == {"web/util.ts"} and any(r["name"] == "save" for r in rows)
    assert sum(r["tokens"] for r in rows) <= 400 + 500
    assert any(r["name"] == "load" for r in e.task("zzz", symbols=["load"]).collect())
    assert "## web" in e.task_text("save an item", scope=["web/util.ts"])
    e.show(spark.createDataFrame([(r["id"],) for r in rows], "id string"))
    assert not {r["id"] for r in e.task("save an item", variant="lexical", unseen=True).collect()} & {r["id"] for r in rows}
    sections = {r["section"] for r in e.atlas().collect()}
    assert {"components", "entrypoints", "flows", "landmarks", "tests"} <= sections
    assert {r["section"] for r in e.atlas(budget=30).collect()} < sections
    start = e.startup()
    assert "## components" in start["atlas"] and start["surface"]
    assert e.structural(["app/store.py", "app/main.py"], budget=1).count("app/") == 1 and "app/main.py" in e.structural(["app/store.py", "app/main.py"])
    assert e.check_invariants().first()["unknown_scopes"] == 0
    assert e.checkpoint("c")["changed"]
    for form in ("system-ir", "jsonl", "layers", "flow-graphs", "capsule"):
        e.export(form, str(tmp_path / form))
    kinds = {r["type"] for r in spark.read.json(str(tmp_path / "system-ir")).select("type").distinct().collect()}
    assert {"entity", "relationship", "flow", "evidence"} <= kinds
    e.purge_all()
    assert e.table("entities").count() == 0 and e.state.read("flows").count() == 0 and e.state.read("flow_graphs").count() > 0


def test_components_regions_and_services(spark):
    from factloom.operators import components

    rows = spark.createDataFrame([("api", "./svc/api/", "deployment"), ("api", "api", "package"), ("core", "libs", "declared"), ("x", ".", "deployment")], "name string, dir string, boundary string")
    got = {r["name"]: (r["dirs"], r["boundary"]) for r in components.build_candidates(rows).collect()}
    assert got == {"api": (["api", "svc/api"], "deployment"), "core": (["core", "libs"], "declared")}
    files = spark.createDataFrame([("svc/api/a/x.py",), ("svc/api/y.py",), ("libs/z/w.py",), ("top.py",), ("other/q.py",)], "path string")
    regions = {(r["region"], r["component"], r["files"]) for r in components.build_regions(files, components.build_candidates(rows)).collect()}
    assert regions == {("svc/api/a", "api", 1), ("api", "api", 1), ("libs/z", "core", 1), ("root", "root", 1), ("other", "root", 1)}
    pairs = spark.createDataFrame([("a", "b", 20), ("b", "c", 12), ("d", "e", 3)], "a string, b string, weight long")
    assert [r["members"] for r in components.compile_services(pairs).collect()] == [["a", "b", "c"]]


def test_git_and_sandbox(tmp_path):
    from factloom.sources import git

    assert git.resolve_git(str(tmp_path)) == {"revision": None, "branch": None, "remote": None} and git.cache_key(str(tmp_path)) == "nogit"
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git/refs/heads/main").write_text("abc\n")
    (tmp_path / ".git/config").write_text('[remote "origin"]\n\turl = https://h/x.git\n')
    assert git.resolve_git(str(tmp_path)) == {"revision": "abc", "branch": "main", "remote": "https://h/x.git"}
    assert git.sandbox_path(str(tmp_path), "a/b").endswith("a/b")
    with pytest.raises(ValueError, match="outside"):
        git.sandbox_path(str(tmp_path), "../x")
