"""Configuration and infrastructure files as entity and edge rows.

Each reader is a pure function of a file; ``config_facts`` runs the one that a
path asks for over whole partitions. Values of variables never leave a reader.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.functions.text import SECRET_KEYS, SECRET_VALUES
from factloom.session import prepare
from factloom.sources import yamlite

Fact = tuple[str, str, str, str, str]  # kind, name, predicate, object, attributes as JSON

SCHEMA = "path string, kind string, name string, predicate string, object string, attributes string"


def entity(kind: str, name: str, **attributes) -> Fact:
    return kind, name, "", "", json.dumps({k: v for k, v in sorted(attributes.items()) if v not in (None, [], {})}, sort_keys=True)


def edge(kind: str, name: str, predicate: str, target: str) -> Fact:
    return kind, name, predicate, target, "{}"


def env_pairs(text: str) -> list[tuple[str, str]]:
    """KEY=VALUE pairs; comments go, quotes around a value too."""
    out = []
    for line in text.splitlines():
        key, sign, rest = line.strip().partition("=")
        if not sign or not key.strip() or key.startswith("#"):
            continue
        value = rest.strip().split(" #")[0].strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1].strip()
        out.append((key.strip(), value))
    return out


def is_secret(key: str, value: str) -> bool:
    value = value.strip()
    return any(h in key.lower() for h in SECRET_KEYS) or value.startswith(tuple(SECRET_VALUES)) or value.startswith("-----BEGIN") and "PRIVATE KEY" in value


def read_env(path: str, text: str) -> list[Fact]:
    return [entity("secret_reference" if is_secret(k, v) else "configuration", k) for k, v in env_pairs(text)]


def read_package_json(path: str, text: str) -> list[Fact]:
    data = json.loads(text)
    name = data.get("name") or path.rpartition("/")[0] or "root"
    spaces = data.get("workspaces") or []
    spaces = spaces.get("packages", []) if isinstance(spaces, dict) else spaces
    out = [entity("package", name, version=data.get("version"), workspaces=spaces)]
    out += [edge("package", name, "contains", w) for w in spaces]
    bins = data.get("bin") or {}
    out += [entity("entrypoint", b, file=f) for b, f in (bins.items() if isinstance(bins, dict) else [(name, bins)])]
    if data.get("main"):
        out.append(entity("entrypoint", name, file=data["main"]))
    return out + [edge("package", name, "depends_on", d) for d in sorted(data.get("dependencies") or {})]


def read_compose(path: str, text: str) -> list[Fact]:
    out = []
    for doc in yamlite.documents(text):
        for name, s in (doc.get("services") or {}).items():
            s = s or {}
            build = s.get("build")
            out.append(entity("deployment_unit", name, image=s.get("image"), build_context=build.get("context") if isinstance(build, dict) else build, ports=[str(p) for p in s.get("ports") or []]))
            needs = s.get("depends_on") or []
            out += [edge("deployment_unit", name, "depends_on", d) for d in needs]
    return out


def _env_names(container: dict) -> list[str]:
    return sorted(e["name"] for e in container.get("env") or [] if isinstance(e, dict) and "name" in e)


def read_k8s(path: str, text: str) -> list[Fact]:
    out = []
    for doc in yamlite.documents(text):
        if not isinstance(doc, dict) or "kind" not in doc:
            continue
        meta, spec = doc.get("metadata") or {}, doc.get("spec") or {}
        name, kind = meta.get("name") or "unnamed", doc["kind"]
        if kind in ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob"):
            containers = ((spec.get("template") or {}).get("spec") or {}).get("containers") or []
            out.append(entity("deployment_unit", name, image=containers[0].get("image") if containers else None, replicas=spec.get("replicas"), namespace=meta.get("namespace"), env=sorted({n for c in containers for n in _env_names(c)})))
            if meta.get("namespace"):
                out.append(edge("deployment_unit", name, "deployed_in", meta["namespace"]))
        elif kind == "Service":
            out.append(entity("network_service", name, ports=[str(p.get("port")) for p in spec.get("ports") or []]))
        elif kind in ("ConfigMap", "Secret"):
            out.append(entity("configuration" if kind == "ConfigMap" else "secret_reference", name, keys=sorted((doc.get("data") or {}).keys())))
    return out


def read_terraform(path: str, text: str) -> list[Fact]:
    if path.endswith(".json"):
        data = json.loads(text)
        out = [entity("resource", f"{t}.{n}") for t, named in (data.get("resource") or {}).items() for n in named]
        return out + [entity(k, n) for k in ("module", "variable") for n in data.get(k) or {}]
    out = [entity("resource", f"{t}.{n}") for t, n in re.findall(r'(?m)^\s*resource\s+"([^"]+)"\s+"([^"]+)"', text)]
    return out + [entity(k, n) for k, n in re.findall(r'(?m)^\s*(module|variable)\s+"([^"]+)"', text)]


def read_github_actions(path: str, text: str) -> list[Fact]:
    out = []
    for doc in yamlite.documents(text):
        flow = doc.get("name") or path.rpartition("/")[2]
        on = doc.get("on", doc.get(True)) or []
        out.append(entity("workflow", flow, triggers=sorted([on] if isinstance(on, str) else list(on)), env=sorted(doc.get("env") or {})))
        for job, body in (doc.get("jobs") or {}).items():
            needs = (body or {}).get("needs") or []
            out.append(entity("job", f"{flow}/{job}", runs_on=(body or {}).get("runs-on"), needs=[needs] if isinstance(needs, str) else needs, env=sorted((body or {}).get("env") or {})))
            out.append(edge("workflow", flow, "contains", f"{flow}/{job}"))
    return out


def read_dockerfile(path: str, text: str) -> list[Fact]:
    folder = path.rpartition("/")[0]
    lines = re.sub(r"\\\n", " ", text).splitlines()
    base = next((m[1] for m in (re.match(r"(?i)\s*FROM\s+(?:--\S+\s+)*(\S+)", x) for x in lines) if m), None)
    env = sorted({n for x in lines if (m := re.match(r"(?i)\s*ENV\s+(.*)", x)) for n in (re.findall(r"(\w+)=", m[1]) or m[1].split()[:1])})
    return [entity("deployment_unit", folder.rpartition("/")[2] or "root", base_image=base, env=env)]


def read_intent(path: str, text: str) -> list[Fact]:
    out = []
    for doc in yamlite.documents(text):
        for source, section in (("component", "components"), ("invariant", "invariants"), ("flow", "flows")):
            for name, body in (doc.get(section) or {}).items():
                out.append(entity(f"intent_{source}", name, **{k: v for k, v in (body or {}).items()}))
    return out


def read_members(path: str, text: str) -> list[Fact]:
    """Workspace members of Cargo.toml and go.work."""
    if path.endswith("go.work"):
        block = " ".join(re.findall(r"use\s*\(([^)]*)\)", text)) + " " + " ".join(re.findall(r"(?m)^use\s+([^(\s]+)", text))
        return [entity("package", m.removeprefix("./")) for m in block.split()]
    m = re.search(r"(?s)\[workspace\].*?members\s*=\s*\[(.*?)\]", text)
    name = re.search(r'(?s)\[package\].*?name\s*=\s*"([^"]+)"', text)
    return [entity("package", x) for x in re.findall(r'"([^"]+)"', m[1])] * bool(m) + [entity("package", name[1])] * bool(name) if m or name else []


def reader(path: str):
    """The reader that a path asks for."""
    name = path.rpartition("/")[2].lower()
    if name == "package.json":
        return read_package_json
    if name.startswith(("docker-compose", "compose")) and name.endswith((".yml", ".yaml")):
        return read_compose
    if name.startswith(".env") or name.endswith(".env"):
        return read_env
    if name.endswith((".tf", ".tf.json")):
        return read_terraform
    if name.startswith("dockerfile"):
        return read_dockerfile
    if "intent.y" in name:
        return read_intent
    if name in ("cargo.toml", "go.work"):
        return read_members
    if ".github/workflows/" in path:
        return read_github_actions
    if name.endswith((".yml", ".yaml")):
        return read_k8s
    return None


def config_facts(files: DataFrame) -> DataFrame:
    """path, kind, name, predicate, object, attributes (JSON) of the files (path, content) that a reader knows.

    A file that can't be read gives one row of kind ``unreadable``; null contents give none.
    """
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                read = reader(path or "")
                if read is None or text is None:
                    continue
                try:
                    out += [(path, *f) for f in dict.fromkeys(read(path, text))]
                except (ValueError, AttributeError, TypeError, KeyError):
                    out.append((path, "unreadable", path, "", "", "{}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(6)], names=["path", "kind", "name", "predicate", "object", "attributes"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)
