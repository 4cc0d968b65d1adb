"""Facts of source files: Python by its own parser, other languages by a grammar of statements.

``extract`` is a pure function of (path, language, content) and gives tagged rows
(family, name, kind, line, end_line, owner, detail). ``source_facts`` runs it over
whole partitions; one row per fact, so families are filters on the result.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.session import prepare
from factloom.sources import frameworks as fw
from factloom.sources.statements import statements

Row = tuple[str, str, str, int, int, str, str]

SCHEMA = "path string, family string, name string, kind string, line int, end_line int, owner string, detail string"

# Method names that read, write and publish; decorators and calls that make routes and jobs.
READS = "get find findone findmany findunique fetch fetchone fetchall query select read load scan filter all first hgetall".split()
WRITES = "set put insert insertone create update updateone upsert delete deleteone save write store add commit hset merge".split()
PUBLISHES = "publish emit send sendmessage enqueue produce dispatch send_message".split()
SUBSCRIBES = "subscribe consume on_message basic_consume process".split()
HTTP = "get post put delete patch head options".split()
_SQL = re.compile(r"(?is)\b(select\b.*?\bfrom|insert\s+into|update|delete\s+from)\s+[\"'`]?([A-Za-z_][\w.]*)")


def fact(family: str, name: str, kind: str, line: int, end: int | None = None, owner: str = "", **detail) -> Row:
    return family, name, kind, line, end or line, owner, json.dumps({k: v for k, v in sorted(detail.items()) if v not in (None, "", [])}, sort_keys=True)


def sql_facts(text: str, line: int, owner: str) -> list[Row]:
    out = []
    for verb, table in _SQL.findall(text):
        out.append(fact("store", table, "read" if verb.lower().startswith("select") else "write", line, owner=owner, via="sql"))
    return out


def store_kind(method: str) -> str | None:
    low = method.lower()
    return next((k for k, names in (("publish", PUBLISHES), ("subscribe", SUBSCRIBES), ("write", WRITES), ("read", READS)) if low in names), None)


class _Python(ast.NodeVisitor):
    """Walks one module; ``scope`` is the chain of classes and functions around a node."""

    def __init__(self, path: str):
        self.path, self.rows, self.scope, self.order, self.block = path, [], [], {}, []
        self.modules: set[str] = set()  # roots of what the module imports, from any place in it
        self.classes: set[str] = set()

    @property
    def owner(self) -> str:
        return ".".join(self.scope)

    def add(self, *a, **k) -> None:
        self.rows.append(fact(*a, **k))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name.split(".")[0], "module", node.lineno, module=a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", a.asname or a.name, "name", node.lineno, module=module, imported=a.name)

    def _def(self, node, kind: str) -> None:
        exported = not node.name.startswith("_") and not (self.scope and kind == "function")
        whole = ".".join([*self.scope, node.name])
        signature = None if kind == "class" else f"{node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        self.add("symbol", node.name, kind, node.lineno, node.end_lineno, self.owner, exported=exported, signature=signature, docstring=(ast.get_docstring(node) or "").split("\n")[0])
        for d in node.decorator_list:
            self._decorator(d, node, whole)
        if kind != "class" and node.name.startswith("test"):
            self.add("test", node.name, "pytest", node.lineno, node.end_lineno, self.owner, tokens=[t for t in re.split(r"[^a-z0-9]+", node.name.lower()) if t and t != "test"])
        if kind == "class":
            for b in node.bases:
                self.add("inherits", ast.unparse(b), "base", node.lineno, owner=node.name)
                if ast.unparse(b).split(".")[-1] in ("BaseModel", "Schema", "TypedDict"):
                    self.add("schema", node.name, "model", node.lineno, node.end_lineno)
                elif "pydantic" in self.modules and ast.unparse(b) in self.classes:
                    self.add("composition", ast.unparse(b), "inherits", node.lineno, owner=node.name)
            for x in node.body:
                if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                    self.add("state", x.target.id, "field", x.lineno, owner=whole, mutable="Final" not in ast.unparse(x.annotation))
        elif kind == "function" and not self.scope and fw.is_factory("python", node.name):
            self.add("factory", node.name, "function", node.lineno, node.end_lineno, self.owner)
        elif kind == "method" and fw.is_builder(node.name) and any(isinstance(x, ast.Return) and isinstance(x.value, ast.Name) and x.value.id == "self" for x in node.body):
            self.add("registration", self.owner, "builder", node.lineno, owner=self.owner)
        self.scope.append(node.name)
        for x in (*([] if kind == "class" else [node.args]), *node.body):
            self.visit(x)
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        self._def(node, "method" if self.scope and self.scope[-1][:1].isupper() else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._def(node, "class")

    def _decorator(self, d: ast.expr, node, whole: str) -> None:
        call = d if isinstance(d, ast.Call) else None
        name = ast.unparse(call.func if call else d)
        last, parent, line = name.split(".")[-1], self.owner, node.lineno
        first = call.args[0].value if call and call.args and isinstance(call.args[0], ast.Constant) else None
        web = bool(self.modules & {"fastapi", "flask"})
        if last in (*HTTP, "route", "websocket") and isinstance(first, str):
            methods = [ast.literal_eval(k.value) for k in call.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in k.value.elts)]
            for m in methods[0] if methods else ["GET" if last == "route" else last.upper()]:
                self.add("route", f"{m} {first}", "http", line, owner=whole)
                if web:
                    self.add("registration", f"{m} {first}", "route", line, owner=whole)
        elif call and last in ("command", "group"):
            self.add("cli", str(first or node.name.replace("_", "-")), "subcommand", line, owner=whole)
        elif call and last == "option":
            for flag in (a.value for a in call.args if isinstance(a, ast.Constant) and isinstance(a.value, str) and a.value.startswith("-") and len(a.value) > 1):
                self.add("cli", flag, "flag", line, owner=whole)
        elif last in ("task", "shared_task", "job", "scheduled_job", "periodic_task", "on_event", "listener"):
            self.add("queue", str(first or node.name), "schedule" if last == "scheduled_job" else last, line, owner=whole)
        elif last == "consumer":
            self.add("store", str(first or "queue"), "subscribe", line, owner=whole, via="queue")
        elif last == "dataclass":
            self.add("schema", node.name, "dataclass", line, node.end_lineno)
        if "retry" in name.lower() or "backoff" in name.lower():
            self.add("retry", whole, name, line, owner=whole, policy=ast.unparse(d))
        if last == "task" and "celery" in self.modules:
            self.add("registration", whole, "task", line, owner=parent or whole)
        if last in ("classmethod", "staticmethod") and parent and fw.is_factory("python", node.name):
            self.add("registration", parent, "factory", line, owner=parent)
        if last in ("validator", "field_validator", "validates") and parent and "pydantic" in self.modules:
            self.add("validation", parent, "validator", line, owner=whole)
        hook = str(first) if last == "on_event" and first else last if last in ("on_startup", "on_shutdown") else None
        if "fastapi" in self.modules and hook or "flask" in self.modules and last in fw.FLASK_HOOKS:
            self.add("callback", hook or last, "lifecycle", line, owner=whole)
        framework = {"task": "celery", "on_event": "fastapi", "on_startup": "fastapi", "on_shutdown": "fastapi", **dict.fromkeys(fw.FLASK_HOOKS, "flask")}.get(last)
        if (web if last in (*HTTP, "route") else framework is None or framework in self.modules):
            self.add("annotation", name, "decorator", line, owner=whole)

    def _framework_call(self, name: str, last: str, first: str | None, node: ast.Call) -> None:
        """Facts of calls into frameworks that the module imports."""
        has, line, owner = self.modules.__contains__, node.lineno, self.owner
        receiver, arg = name.split(".")[0], ast.unparse(node.args[0]) if node.args else ""
        plain = bool(node.args) and isinstance(node.args[0], ast.Name)
        given = {k.arg: k.value.value for k in node.keywords if isinstance(k.value, ast.Constant)}
        if last == "AIOKafkaConsumer" and has("aiokafka"):
            self.add("store", first or "kafka", "subscribe", line, owner=owner, via="kafka")
        elif last == "basic_consume" and has("pika"):
            self.add("store", str(first or given.get("queue") or "queue"), "subscribe", line, owner=owner, via="rabbit")
        elif last == "add_job" and has("apscheduler") and plain:
            self.add("queue", arg, "schedule", line, owner=owner)
        elif last == "setup" and has("setuptools") and any(k.arg == "entry_points" for k in node.keywords):
            self.add("registration", "entry_points", "plugin", line, owner=owner)
        elif last in ("model_validate", "model_validate_json", "parse_obj") and has("pydantic") and name.count(".") == 1 and receiver not in ("self", "cls"):
            self.add("validation", receiver, last, line, owner=owner)
        elif last == "Blueprint" and has("flask") and first:
            self.add("registration", first, "blueprint", line, owner=owner)
        elif arg and (last in ("include_router", "add_middleware", "add_exception_handler") and has("fastapi") or last == "register_blueprint" and has("flask")):
            self.add("registration", arg, last, line, owner=owner or receiver)
        parts = name.split(".")
        if last == "get" and first and len(parts) > 1 and (parts[0] in ("settings", "config") or len(parts) > 2 and parts[-2] in ("settings", "config")):
            self.add("config", first, "setting", line, owner=owner)

    def visit_Call(self, node: ast.Call) -> None:
        name = ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else ""
        if name:
            receiver, _, last = name.rpartition(".")
            n = self.order[self.owner] = self.order.get(self.owner, 0) + 1
            self.add("call", last, "call", node.lineno, owner=self.owner, receiver=receiver or None, order=n, block=self.block[-1] if self.block else None)
            first = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else None
            kind = store_kind(last)
            if kind and receiver and first and not _SQL.search(first):
                self.add("store", first, kind, node.lineno, owner=self.owner, via=receiver)
            if first and _SQL.search(first):
                self.rows += sql_facts(first, node.lineno, self.owner)
            if name in ("os.getenv", "os.environ.get", "getenv") and first:
                self.add("config", first, "env", node.lineno, owner=self.owner)
            if last == "add_argument":
                for flag in (a.value for a in node.args if isinstance(a, ast.Constant) and isinstance(a.value, str) and len(a.value) > 1):
                    self.add("cli", flag, "flag" if flag.startswith("-") else "argument", node.lineno, owner=self.owner)
            if last == "add_parser" and first:
                self.add("cli", first, "subcommand", node.lineno, owner=self.owner)
            self._framework_call(name, last, first, node)
            if last == "add_url_rule" and first:
                self.add("route", f"GET {first}", "http", node.lineno, owner=self.owner)
        if isinstance(node.func, ast.Attribute):  # the name called is no setting, what it is called on may be a call itself
            if not name:
                self.visit(node.func)
        else:
            self.visit(node.func)
        for x in (*node.args, *node.keywords):
            self.visit(x)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if isinstance(node.value, (ast.Name, ast.Attribute)) and isinstance(node.slice, ast.Constant):
            of = ast.unparse(node.value)
            if of in ("os.environ", "environ") or of.split(".")[-1] == "config" and isinstance(node.slice.value, str):
                self.add("config", str(node.slice.value), "env" if "environ" in of else "setting", node.lineno, owner=self.owner)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                self.add("state", t.attr, "field", node.lineno, owner=".".join(self.scope[:-1]), mutable=True)
            elif isinstance(t, ast.Name) and self.scope and self.scope[-1] in self.classes:
                self.add("state", t.id, "field", node.lineno, owner=self.owner, mutable=True)
            elif isinstance(t, ast.Name) and not self.scope:
                self.add("symbol", t.id, "constant" if t.id.isupper() else "variable", node.lineno, node.end_lineno, exported=not t.id.startswith("_"))
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        """Settings read as attributes; of a chain the outermost, and not what is called."""
        parts = ast.unparse(node).split(".") if isinstance(node.value, (ast.Name, ast.Attribute)) else []
        if self.scope and len(parts) > 1 and (parts[0] in ("settings", "config") or len(parts) > 2 and parts[-2] in ("settings", "config")):
            self.add("config", parts[-1], "setting", node.lineno, owner=self.owner)
        elif not isinstance(node.value, ast.Attribute):
            self.generic_visit(node)
        else:
            self.visit(node.value)

    def _within(self, name: str, node) -> None:
        self.block.append(name)
        self.generic_visit(node)
        self.block.pop()

    def visit_If(self, node) -> None:
        self._within("branch", node)

    def visit_For(self, node) -> None:
        self._within("loop", node)

    visit_While = visit_AsyncFor = visit_For

    def visit_Try(self, node) -> None:
        self._within("try", node)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        self.add("failure", ast.unparse(node.type) if node.type else "Exception", "except", node.lineno, owner=self.owner)
        self._within("error", node)


def extract_python(path: str, text: str) -> list[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [fact("unparsed", path, "python", 1)]
    walker = _Python(path)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            walker.modules |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            walker.modules.add(node.module.split(".")[0])
        elif isinstance(node, ast.ClassDef):
            walker.classes.add(node.name)
    try:
        walker.visit(tree)
    except RecursionError:  # nested beyond what Python walks
        return [fact("unparsed", path, "python", 1)]
    return walker.rows


# A grammar of statements: family, kind, and a pattern whose group ``n`` is the name.
GRAMMARS: dict[str, list[tuple[str, str, str]]] = {
    "typescript": [
        ("symbol", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>\w+)"),
        ("symbol", "interface", r"^\s*(?:export\s+)?interface\s+(?P<n>\w+)"),
        ("symbol", "type", r"^\s*(?:export\s+)?type\s+(?P<n>\w+)\s*[=<]"),
        ("symbol", "enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<n>\w+)"),
        ("symbol", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(?P<n>\w+)"),
        ("symbol", "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<n>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
        ("symbol", "constant", r"^(?:export\s+)?const\s+(?P<n>\w+)\s*(?::[^=]+)?=\s*(?!.*=>)"),
        ("symbol", "method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?P<n>(?!if|for|while|switch|catch|return|function)\w+)\s*\([^;]*\)\s*(?::\s*[^{=]+)?\{.*$"),
        ("inherits", "base", r"\bextends\s+(?P<n>[\w.]+)"),
        ("implements", "interface", r"\bimplements\s+(?P<n>[\w.]+)"),
        ("import", "module", r"^\s*(?:import|export)\b.*?\bfrom\s+['\"](?P<n>[^'\"]+)['\"]"),
        ("import", "module", r"^\s*import\s+['\"](?P<n>[^'\"]+)['\"]"),
        ("import", "require", r"\brequire\(\s*['\"](?P<n>[^'\"]+)['\"]\s*\)"),
        ("route", "http", r"\b(?P<r>app|router|server|fastify|api)\.(?P<m>get|post|put|delete|patch)\(\s*['\"`](?P<n>[^'\"`]+)"),
        ("queue", "consumer", r"\bnew\s+Worker\(\s*['\"`](?P<n>[^'\"`]+)"),
        ("queue", "producer", r"\bnew\s+Queue\(\s*['\"`](?P<n>[^'\"`]+)"),
        ("config", "env", r"process\.env\.(?P<n>[A-Z_][A-Z0-9_]*)"),
        ("config", "env", r"process\.env\[['\"](?P<n>[^'\"]+)['\"]\]"),
        ("test", "jest", r"^\s*(?:it|test|describe)\(\s*['\"`](?P<n>[^'\"`]+)"),
        ("schema", "zod", r"(?:const\s+)(?P<n>\w+)\s*=\s*z\.object\("),
        ("failure", "catch", r"\b(?P<n>catch)\s*[({]"),
        ("retry", "policy", r"\b(?P<n>attempts|retries|maxRetries)\s*:"),
    ],
    "go": [
        ("symbol", "method", r"^func\s+\((?P<o>[^)]*)\)\s*(?P<n>\w+)"),
        ("symbol", "function", r"^func\s+(?P<n>\w+)"),
        ("symbol", "struct", r"^type\s+(?P<n>\w+)\s+struct"),
        ("symbol", "interface", r"^type\s+(?P<n>\w+)\s+interface"),
        ("symbol", "constant", r"^const\s+(?P<n>\w+)"),
        ("symbol", "variable", r"^var\s+(?P<n>\w+)"),
        ("import", "module", r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<n>[\w./-]+)\"\s*$"),
        ("cli", "command", r"\bUse:\s*\"(?P<n>[\w-]+)"),
        ("cli", "flag", r"\bflag\.\w+\(\s*\"(?P<n>[^\"]+)\""),
        ("config", "env", r"os\.(?:Getenv|LookupEnv)\(\"(?P<n>[^\"]+)\"\)"),
        ("async", "goroutine", r"^\s*go\s+(?P<n>[\w.]+)"),
        ("failure", "panic", r"\b(?P<n>panic)\("),
        ("schema", "tag", r"^\s+(?P<n>\w+)\s+[\w.*\[\]]+\s+`json:"),
    ],
    "java": [
        ("symbol", "class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|record)\s+(?P<n>\w+)"),
        ("symbol", "interface", r"^\s*(?:public\s+)?interface\s+(?P<n>\w+)"),
        ("symbol", "enum", r"^\s*(?:public\s+)?enum\s+(?P<n>\w+)"),
        ("symbol", "method", r"^\s*(?:(?:public|private|protected|static|final|synchronized|abstract|default|native)\s+)*(?:<[^>]*>\s*)?(?:[\w.]+(?:<[^;(]*>)?(?:\[\])*\s+)?(?P<n>\w+)\s*\([^;]*\)\s*(?:throws\s+[\w, .]+)?(?:\{.*|;\s*)$"),
        ("inherits", "base", r"\bextends\s+(?P<n>[\w.]+)"),
        ("implements", "interface", r"\bimplements\s+(?P<n>[\w., ]+)"),
        ("import", "module", r"^import\s+(?:static\s+)?(?P<n>[\w.*]+);"),
        ("failure", "catch", r"\b(?P<n>catch)\s*\("),
        ("config", "env", r"System\.getenv\(\"(?P<n>[^\"]+)\"\)"),
        ("config", "value", r"@Value\(\"\$\{(?P<n>[^}:\"]+)"),
    ],
    "rust": [
        ("symbol", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<n>\w+)"),
        ("symbol", "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"),
        ("symbol", "enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"),
        ("symbol", "trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)"),
        ("symbol", "constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?P<n>[A-Z_][A-Z0-9_]*)"),
        ("implements", "trait", r"^\s*impl(?:<[^>]*>)?\s+(?P<n>[\w:<>]+)\s+for\s+(?P<o>\w+)"),
        ("import", "module", r"^\s*(?:pub\s+)?use\s+(?P<n>[\w:{}, *]+);"),
        ("import", "module", r"^\s*(?:pub\s+)?mod\s+(?P<n>\w+);"),
        ("route", "http", r"\.route\(\s*\"(?P<n>[^\"]+)\""),
        ("route", "attribute", r"#\[(?P<m>get|post|put|delete|patch)\(\"(?P<n>[^\"]+)\""),
        ("cli", "command", r"\bCommand::new\(\"(?P<n>[^\"]+)\""),
        ("config", "env", r"env::var(?:_os)?\(\"(?P<n>[^\"]+)\"\)"),
        ("failure", "panic", r"\b(?P<n>panic!|unreachable!|todo!)"),
        ("failure", "unwrap", r"\.(?P<n>unwrap|expect)\("),
    ],
}
GRAMMARS["javascript"] = GRAMMARS["typescript"]
_COMPILED = {lang: [(f, k, re.compile(p)) for f, k, p in rules] for lang, rules in GRAMMARS.items()}
_CALL = re.compile(r"(?<![\w@.:])(?:([\w.]+?(?:::\w+)*?)(?:\.|::))?(\w+)!?\(|(?<=[)\]}])\??\.(\w+)\(")
_NOT_CALLS = frozenset("if for while switch catch return function func fn match else new await typeof sizeof super loop select defer go pub use impl async move in as".split())
_TYPES = frozenset("class interface enum struct trait record impl".split())
_CONTROL = re.compile(r"\s*(?:\}\s*)?(?:'\w+:\s*)?(?:(?P<branch>else|if|switch|match|select)|(?P<loop>for|while|loop|do)|(?P<try>try)|(?P<error>catch|finally))\b")
_ANNOTATION = re.compile(r"@([A-Za-z_][\w.]*)\s*(\((?:[^()]|\([^()]*\))*\))?")
_ATTRIBUTE = re.compile(r"#\[\s*([\w:]+)\s*([^\]]*(?:\[[^\]]*\][^\]]*)*)\]")
_FIELDS = {
    "go": re.compile(r"\s*(?P<n>[A-Za-z_]\w*(?:\s*,\s*\w+)*)\s+(?P<t>[\w.*\[\]{}() ]+?)\s*(?:`.*)?$", re.DOTALL),
    "java": re.compile(r"\s*(?P<m>(?:(?:public|private|protected|static|final|transient|volatile)\s+)*)(?P<t>[\w.]+(?:<[^=;(]*>)?(?:\[\])*)\s+(?P<n>\w+)\s*(?:=[^=].*|;.*)$", re.DOTALL),
    "typescript": re.compile(r"\s*(?P<m>(?:(?:public|private|protected|static|readonly|declare|override|abstract)\s+)*)(?P<n>#?[A-Za-z_$]\w*)[?!]?\s*(?::(?P<t>[^=]+))?(?:=(?!>).*)?;?\s*$", re.DOTALL),
    "rust": re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?P<n>[a-z_]\w*)\s*:\s*(?P<t>[^=]+?),?\s*$", re.DOTALL),
}
_FIELDS["javascript"] = _FIELDS["typescript"]
_IMPL = re.compile(r"\s*(?:unsafe\s+)?impl\b(?:<[^{]*?>(?=\s))?\s*(?:[^{]*?\bfor\s+)?&?(?:\w+::)*(?P<n>\w+)")
_RECEIVER = re.compile(r"\s*(?:(?P<v>\w+)\s+)?\*?\s*(?P<t>\w+)")


class _Statements:
    """Reads one file: declarations own what lies in their braces, annotations wait for what they stand before."""

    def __init__(self, language: str):
        self.language, self.rows = language, []
        self.owners: list[tuple[str, int, str, str]] = []  # name, braces around, kind, variable of a Go receiver
        self.blocks: list[tuple[str, int]] = []
        self.marks: list[tuple[str, str, int]] = []
        self.order: dict[str, int] = {}
        self.modules: set[str] = set()
        self.prefixes: dict[str, str] = {}  # paths of classes
        self.routers = fw.GoRouters()
        self.depth = 0

    def add(self, *a, **k) -> None:
        self.rows.append(fact(*a, **k))

    def read(self, s) -> None:
        braces = [c for c in s.bare if c in "{}"]
        run = low = 0
        for c in braces:
            run += 1 if c == "{" else -1
            low = min(low, run)
        self.depth += low
        for held in (self.owners, self.blocks):
            while held and self.depth <= held[-1][1]:
                held.pop()
        rest = self._marks(s)
        if rest:
            control = _CONTROL.match(s.bare)
            block = control.lastgroup if control else None
            owner, kind = (self.owners[-1][0], self.owners[-1][2]) if self.owners else ("", "")
            declared = self._declared(s, owner, kind)
            whole, declared_kind, receiver = declared or (owner, "", "")
            inner = whole if declared and declared_kind not in ("constant", "variable", "type") else owner
            if not declared and kind in _TYPES and self.depth == self.owners[-1][1] + 1:
                self._field(s, owner, kind)
            self._uses(s, whole, inner, block, receiver or (self.owners[-1][3] if self.owners else ""))
            if declared or not control:
                self.marks = []
            if run > low:
                if declared and inner == whole:
                    self.owners.append((whole, self.depth, declared_kind, receiver))
                elif block:
                    self.blocks.append((block, self.depth))
        self.depth += run - low

    def _marks(self, s) -> bool:
        """Take the annotations that a statement begins with; whether anything follows them."""
        if self.language == "go":
            return True
        pattern = _ATTRIBUTE if self.language == "rust" else _ANNOTATION
        at = len(s.text) - len(s.text.lstrip())
        while (m := pattern.match(s.text, at)) and m[1] != "interface":
            self.marks.append((m[1], m[2] or "", s.at(m.start())))
            at = m.end()
            at += len(s.text[at:]) - len(s.text[at:].lstrip())
        return at < len(s.text)

    def _declared(self, s, owner: str, owner_kind: str) -> tuple[str, str, str] | None:
        """The symbol that a statement declares: its name with its owner, its kind, and the variable of its receiver."""
        language, text = self.language, s.text
        unmarked = (_ANNOTATION if language in ("java", "typescript", "javascript") else _ATTRIBUTE).sub(lambda m: " " * len(m[0]) if m[1] != "interface" else m[0], text) if text.lstrip()[:1] in "@#" else text
        if language == "rust" and (m := _IMPL.match(s.bare)) and "{" in s.bare:
            for t in re.finditer(r"impl(?:<[^>]*>)?\s+([\w:<>]+)\s+for\s+(\w+)", text):
                self.add("implements", t[1], "trait", s.line, owner=t[2])
            return m["n"], "impl", ""
        bare = language in ("javascript", "typescript")
        for family, kind, pattern in _COMPILED[language]:
            if family != "symbol" or not (m := pattern.search(unmarked)):
                continue
            member = owner_kind in _TYPES and self.depth == self.owners[-1][1] + 1
            if kind == "method" and language != "go" and not member:
                continue
            name, receiver = m["n"].strip(), ""
            if "o" in m.groupdict():
                found = _RECEIVER.match(m["o"])
                owner, receiver = (found["t"], found["v"] or "") if found else ("", "")
            if language == "rust" and kind == "function" and owner_kind in ("impl", "trait"):
                kind = "method"
            exported = bool(re.search(r"\bexport\b", text)) if bare else bool(re.search(r"\bpub\b", text)) if language == "rust" else bool(re.match(r"[A-Z]", name)) if language == "go" else "public" in text or owner_kind == "interface"
            signature = unmarked[m.start() :].split("{")[0] if kind in ("function", "method") else unmarked[m.start() :].rstrip().rstrip("{")
            line = s.at(m.start("n"))
            self.add("symbol", name, kind, line, owner=owner, exported=exported, signature=re.sub(r"\s+", " ", signature).strip())
            whole = f"{owner}.{name}" if owner else name
            self._made(s, name, whole, kind, owner, unmarked, line)
            self._annotated(name, whole, kind, owner, line)
            return whole, kind, receiver
        return None

    def _made(self, s, name: str, whole: str, kind: str, owner: str, text: str, line: int) -> None:
        """Factories, builders, tests and schemas by their declarations."""
        language = self.language
        if kind in ("function", "method"):
            head = text.split("{")[0]
            returns = head[head.rfind(")") + 1 :]
            if fw.is_factory(language, name):
                if not owner:
                    self.add("factory", name, kind, line)
                elif language == "rust" or language == "java" and re.search(r"\bstatic\b", text):
                    self.add("registration", owner, "factory", line, owner=owner)
            elif owner and fw.is_builder(name) and (language == "rust" and re.search(r"->\s*(?:&mut\s+)?(?:Self|" + re.escape(owner) + r")\b", text) or language == "go" and re.match(rf"\s*\*?{re.escape(owner)}\b", returns)):
                self.add("registration", owner, "builder", line, owner=owner)
            if language == "go" and name.startswith("Test"):
                self.add("test", name, "go", line)
        if language in ("typescript", "javascript") and kind == "class":
            for m in re.finditer(r"\b(controllers|providers|imports|exports)\s*:\s*\[([^\]]*)\]", next((t for n, t, _ in self.marks if n == "Module"), "")):
                for target in re.findall(r"(?<![\w.(])[A-Za-z_]\w*(?=\s*(?:,|$))", m[2]):
                    self.add("registration", target, m[1], line, owner=whole)

    def _annotated(self, name: str, whole: str, kind: str, owner: str, line: int) -> None:
        """What the annotations before a declaration say about it."""
        marks, java = [(n.split(".")[-1], t) for n, t, _ in self.marks], self.language == "java"
        spring = java and fw.imported(self.modules, r"^org\.springframework")
        for (n, text), (_, _, at) in zip(marks, self.marks, strict=True):
            if "retry" in n.lower() or "backoff" in n.lower():
                self.add("retry", whole, n, at, owner=whole, policy=f"{n}{text}"[:200])
            if self.language == "rust":
                names = re.findall(r"(\w+)\s*(?=,|\)|$)", text.strip("() ")) if n == "derive" else [n]
                for x in names:
                    self.add("annotation", x, "derive" if n == "derive" else "attribute", at, owner=whole)
                if n == "derive" and {"Serialize", "Deserialize"} & set(names):
                    self.add("schema", name, "serde", line)
                if n.lower() in fw.HTTP_VERBS and (path := re.search(r"\"([^\"]+)\"", text)):
                    self.add("route", f"{n.upper()} {path[1]}", "attribute", line, owner=whole)
                if n == "test" or n.endswith("::test"):
                    self.add("test", name, "rust", line, owner=owner)
                continue
            if not java or fw.annotation_counts(n, self.modules):
                self.add("annotation", n, "annotation" if java else "decorator", at, owner=whole)
            if not java:
                path = re.search(r"['\"`]([^'\"`]*)", text)
                if n == "Controller" and kind == "class":
                    self.prefixes[whole] = path[1] if path else ""
                elif n.lower() in fw.HTTP_VERBS and n[0].isupper() and kind == "method":
                    self.add("route", f"{n.upper()} {fw.join_path(self.prefixes.get(owner, ''), path[1] if path else '')}", "decorator", line, owner=whole)
                continue
            if n == "Test" and kind == "method":
                self.add("test", name, "junit", line, owner=owner)
            if spring and kind == "method" and (n in fw.MAPPINGS or n == "Bean"):
                self.add("registration", whole, "bean" if n == "Bean" else "route", line, owner=owner)
            if spring and n == "Scheduled":
                self.add("queue", name, "schedule", line, owner=whole)
            store = {"RabbitListener": ("rabbitmq", "amqp"), "KafkaListener": ("kafka", "kafka")}.get(n)
            if store and fw.imported(self.modules, rf"^org\.springframework\.{store[1]}"):
                literal = re.search(r"\"([^\"]+)\"", text)
                self.add("store", literal[1] if literal else store[0], "subscribe", line, owner=whole, via=store[0])
            if n in ("JmsListener", "EventListener"):
                self.add("queue", name, "listener", line, owner=whole)
            if n in fw.LIFECYCLE and fw.imported(self.modules, r"^org\.junit"):
                self.add("callback", whole, "lifecycle", line, owner=owner)
        if java and kind in ("class", "interface"):
            paths = [re.search(r"\"([^\"]*)\"", t) for n, t in marks if n == "RequestMapping"]
            self.prefixes[whole] = paths[0][1] if paths and paths[0] else ""
        elif java and kind == "method" and (route := fw.spring_route(marks, self.prefixes.get(owner, ""))):
            self.add("route", route, "annotation", line, owner=whole)

    def _field(self, s, owner: str, kind: str) -> None:
        """A field of the type around, with its annotations."""
        text = _ANNOTATION.sub(" ", s.text) if self.language in ("java", "typescript", "javascript") else s.text if self.language == "go" else _ATTRIBUTE.sub(" ", s.text)
        m = _FIELDS[self.language].match(text)
        if not m or kind in ("impl", "enum", "trait") or self.language == "go" and kind != "struct" or m["n"] in ("return", "package", "case", "default"):
            return
        g = m.groupdict()
        said, type_ = (g.get("m") or "").split(), (g.get("t") or "").strip()
        for name in re.split(r"\s*,\s*", m["n"]):
            mutable = {"go": True, "java": "final" not in said and kind != "interface", "rust": any(t in type_ for t in fw.INNER_MUTABLE)}.get(self.language, "readonly" not in said)
            self.add("state", name, "field", s.line, owner=owner, mutable=mutable)
            for n, t, at in self.marks:
                if self.language == "rust":
                    if n == "serde" and "flatten" in t and (parent := re.fullmatch(r"(?:Option<)?\s*(\w+)\s*>?", type_)):
                        self.add("composition", parent[1], "flatten", at, owner=owner)
                    if n == "arg" and (flag := re.search(r"\blong\b(?:\s*=\s*\"([^\"]+)\")?", t)):
                        self.add("cli", f"--{flag[1] or name.replace('_', '-')}", "flag", at, owner=owner)
                elif self.language != "java" or fw.annotation_counts(n, self.modules):
                    self.add("annotation", n, "annotation", at, owner=f"{owner}.{name}")
                    if n == "Rule" and self.language == "java":
                        self.add("registration", f"{owner}.{name}", "rule", at, owner=owner)
        if self.language == "go" and (tag := re.search(r"`[^`]*\b(?:json|yaml|db|validate):", s.text)):
            self.add("schema", owner, "tag", s.at(tag.start()))

    def _uses(self, s, whole: str, inner: str, block: str | None, variable: str) -> None:
        """Imports, framework facts, calls and store accesses of a statement."""
        language, text = self.language, s.text
        for family, kind, pattern in _COMPILED[language]:
            if family == "symbol" or family == "implements" and language == "rust":
                continue
            for m in pattern.finditer(text):
                name, g = m["n"].strip(), m.groupdict()
                if family == "import":
                    self.modules.add(name)
                if family == "route":
                    name = f"{(g.get('m') or 'any').upper()} {name}"
                    if kind == "http" and "express" in self.modules and (inner or g.get("r")):
                        self.add("registration", name, "route", s.at(m.start()), owner=inner or g["r"])
                self.add(family, name, kind, s.at(m.start()), owner=whole if family in ("inherits", "implements") else inner)
        for place, family, kind, name, owner, via in fw.gated(language, self.modules, text):
            own = owner or inner or (via if family == "registration" else "")
            self.add(family, name, kind, s.at(place), owner=own, via=via if family == "store" else None)
        if language == "go":
            for place, family, kind, name in self.routers.read(text):
                self.add(family, name, kind, s.at(place), owner=inner)
        if language == "rust" and fw.imported(self.modules, r"^clap\b"):
            for place, flag in fw.clap_flags(text):
                self.add("cli", flag, "flag", s.at(place), owner=inner)
        if re.match(r"\s*return\s+this\s*;?\s*$", s.bare) and self.owners and "." in self.owners[-1][0]:
            of, _, name = self.owners[-1][0].rpartition(".")
            if fw.is_builder(name):
                self.add("registration", of, "builder", s.line, owner=of)
        self._calls(s, whole, inner, block, variable)
        for m in _SQL.finditer(text):
            self.rows += sql_facts(m[0], s.at(m.start()), inner)

    def _calls(self, s, whole: str, inner: str, block: str | None, variable: str) -> None:
        block = block or (self.blocks[-1][0] if self.blocks and (not self.owners or self.blocks[-1][1] >= self.owners[-1][1]) else None)
        if re.match(r"\s*(?:import|package|use)\b", s.bare):
            return
        own = whole.rpartition(".")[2]
        for m in _CALL.finditer(s.bare):
            name = m[2] or m[3]
            if name in _NOT_CALLS and not m[1] or name == own and whole == inner and not m[1] and not m[3] and s.bare[: m.start()].count("{") == 0:
                continue
            receiver = "self" if m[1] and m[1] in ("this", "self", "Self", variable) else m[1]
            if m[3]:
                receiver = "()"
            n = self.order[inner] = self.order.get(inner, 0) + 1
            line = s.at(m.start(2) if m[2] else m.start(3))
            self.add("call", name, "call", line, owner=inner, receiver=receiver, order=n, block=block)
            kind = store_kind(name)
            literal = re.compile(r"\s*['\"`]([^'\"`]+)").match(s.text, m.end()) if kind and receiver else None
            if literal and not _SQL.search(literal[1]) and not literal[1].startswith("/"):
                self.add("store", literal[1], kind, line, owner=inner, via=receiver)


def extract_lines(path: str, language: str, text: str) -> list[Row]:
    """Facts by the language's grammar of statements; a fact belongs to the declaration whose braces hold it."""
    reader = _Statements(language)
    for s in statements(language, text):
        reader.read(s)
    return reader.rows


def extract(path: str, language: str | None, text: str | None) -> list[Row]:
    """All facts of one file; other languages and null contents have none."""
    if text is None or language is None:
        return []
    if language == "python":
        return extract_python(path, text)
    return extract_lines(path, language, text) if language in _COMPILED else []


def source_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, language, content), in the order of their lines; repeated facts of a line stay once."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        names = ["path", "family", "name", "kind", "line", "end_line", "owner", "detail"]
        for b in batches:
            out: list[tuple] = []
            for path, lang, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                out += [(path, *r) for r in dict.fromkeys(extract(path, lang, text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)


def parse_signature(signature: str) -> dict:
    """Name, parameters (name, type, default, variadic, receiver) and return type of a signature of any of the five languages."""
    m = re.search(r"(\w+)\s*(?:<[^>]*>)?\s*\(", signature or "")
    if not m:
        return {"name": (signature or "").strip(), "params": [], "returns": None}
    if signature.lstrip().startswith("func (") and signature.count("(") > 1:
        m = re.compile(r"(\w+)\s*\(").search(signature, signature.index(")"))
    depth, end = 0, len(signature)
    for i in range(m.end() - 1, len(signature)):
        depth += (signature[i] in "([{") - (signature[i] in ")]}")
        if not depth:
            end = i
            break
    params = [parse_param(p) for p in split_params(signature[m.end() : end])]
    rest = signature[end + 1 :].strip().rstrip("{:").strip()
    returns = re.sub(r"^(->|:)\s*", "", rest) or None
    return {"name": m[1], "params": params, "returns": returns}


def split_params(text: str) -> list[str]:
    """Split at commas that lie in no bracket."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or c == ">" and text[i - 1 : i] not in ("-", "="))
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def parse_param(text: str) -> dict:
    default = None
    if m := re.search(r"(?<![=!<>])=(?![=>])\s*(.*)$", text):
        default, text = m[1].strip(), text[: m.start()].strip()
    variadic = text.startswith(("*", "...")) or "..." in text
    text = text.lstrip("*").replace("...", "").strip()
    if re.fullmatch(r"&?\s*(mut\s+)?self|this|cls", text):
        return {"name": text.split()[-1].lstrip("&"), "type": None, "default": None, "variadic": False, "receiver": True}
    name, sign, kind = text.partition(":")
    if not sign:
        words = text.split()
        name, kind = (words[-1], " ".join(words[:-1])) if len(words) > 1 and not words[0][0].islower() or "<" in text else (words[0] if words else "", " ".join(words[1:]))
    return {"name": name.strip().rstrip("?"), "type": kind.strip() or None, "default": default, "variadic": variadic, "receiver": False}
