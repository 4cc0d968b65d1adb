"""Facts of frameworks: registrations, callbacks, consumers, schedules, schemas and command lines, each only where its library is imported.

A rule names the imports that it needs, the family and kind of the fact, a pattern
whose group ``n`` is the fact's name (``o`` its owner, where it isn't the symbol
around), and the technology.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_TEXT = r"['\"`](?P<n>[^'\"`]+)"

RULES: dict[str, list[tuple[str, str, str, str, str]]] = {
    "typescript": [
        (r"bullmq$", "store", "subscribe", rf"\bnew\s+Worker\(\s*{_TEXT}", "bullmq"),
        (r"amqplib", "store", "subscribe", rf"\.consume\(\s*{_TEXT}", "rabbitmq"),
        (r"kafkajs$", "store", "subscribe", rf"\.subscribe\(\s*\{{[^}}]*?topics?:\s*\[?\s*{_TEXT}", "kafka"),
        (r"express$", "registration", "middleware", r"\b(?P<r>\w+)\.use\(\s*(?:['\"`][^'\"`]*['\"`]\s*,\s*)?(?P<n>[A-Za-z_][\w.]*)", ""),
        (r"zod", "composition", "extends", r"\b(?P<o>\w+)\s*=\s*(?P<n>[A-Za-z_]\w*)\.(?:extend|merge)\(", ""),
        (r"zod", "validation", "parse", r"(?<![\w.])(?P<n>(?!JSON\b)[A-Za-z_]\w*)\.(?:parse|safeParse)\(", ""),
        (r"^(react|preact)", "reactive", "state", r"\bconst\s+\[?\s*(?P<n>\w+)[^=]*=\s*(?:React\.)?(?:useState|useReducer)\b", ""),
        (r"^(react|preact)", "reactive", "read", r"\bconst\s+(?P<n>\w+)[^=]*=\s*(?:React\.)?useContext\b", ""),
        (r"^vue$|^@vue/", "reactive", "state", r"\bconst\s+(?P<n>\w+)[^=]*=\s*(?:ref|reactive)\b\s*[(<]", ""),
        (r"^vue$|^@vue/|^mobx", "reactive", "derive", r"\bconst\s+(?P<n>\w+)[^=]*=\s*computed\b\s*[(<]", ""),
        (r"^mobx", "reactive", "state", r"\bconst\s+(?P<n>\w+)[^=]*=\s*(?:observable|makeObservable|makeAutoObservable)\b", ""),
        (r"^mobx", "reactive", "write", r"\bconst\s+(?P<n>\w+)[^=]*=\s*action\b", ""),
        (r"", "reactive", "state", r"\b(?:const|let)\s+(?P<n>\w+)[^=]*=\s*\$state\b", ""),
        (r"", "reactive", "derive", r"\b(?:const|let)\s+(?P<n>\w+)[^=]*=\s*\$derived\b", ""),
        (r"^(react|preact)", "callback", "effect", r"\b(?P<n>useEffect)\(", ""),
        (r"^svelte", "callback", "effect", r"\b(?P<n>onMount)\(", ""),
        (r"", "callback", "listener", rf"\.addEventListener\(\s*{_TEXT}", ""),
    ],
    "go": [
        (r"^net/http$", "callback", "handler", r"\bhttp\.HandleFunc\(\s*\"[^\"]*\"\s*,\s*(?P<n>func\b|[\w.]+)", ""),
        (r"/nats\.go$", "store", "subscribe", r"\.(?:Subscribe|QueueSubscribe)\(\s*\"(?P<n>[^\"]+)", "nats"),
        (r"^github\.com/(rabbitmq/amqp091-go|streadway/amqp)$", "store", "subscribe", r"\.Consume\(\s*\"?(?P<n>[\w.-]+)", "rabbitmq"),
        (r"^github\.com/robfig/cron|go-co-op/gocron", "queue", "schedule", r"\.(?:AddFunc|AddJob|AddFuncWithSeconds)\(\s*[^,]+,\s*(?P<n>func\b|[\w.]+)", ""),
        (r"^github\.com/robfig/cron|go-co-op/gocron", "queue", "schedule", r"\.Do\(\s*(?P<n>func\b|[\w.]+)", ""),
        (r"^plugin$", "registration", "plugin", r"\bplugin\.Open\(\s*\"(?P<n>[^\"]+)", ""),
        (r"^encoding/json$", "validation", "unmarshal", r"\bjson\.Unmarshal\([^,]+,\s*&?(?P<n>\w+)\s*\)", ""),
        (r"^github\.com/spf13/cobra$", "cli", "flag", r"\.(?:Persistent)?Flags\(\)\.\w+\((?:[^\",]+,\s*)?\"(?P<n>[^\"]+)", ""),
    ],
    "java": [
        (r"^java\.util\b", "registration", "plugin", r"\bServiceLoader\.load\(\s*(?P<n>\w+)\.class", ""),
        (r"^(javax|jakarta)\.validation\b", "validation", "valid", r"@Valid(?:ated)?\s+(?:@?final\s+)?(?P<n>\w+)\s+\w+", ""),
    ],
    "rust": [
        (r"^clap\b", "cli", "subcommand", r"\.subcommand\(\s*(?:\w+::)*Command::new\(\s*\"(?P<n>[^\"]+)", ""),
        (r"^axum\b", "registration", "route", r"\.route\(\s*\"(?P<n>[^\"]+)", ""),
        (r"^axum\b|^tower", "registration", "middleware", r"\.layer\(\s*(?P<n>[A-Za-z_]\w*)", ""),
        (r"^serde", "validation", "deserialize", r"\bfrom_(?:str|slice|reader|value)::<(?:\w+::)*(?P<n>\w+)", ""),
    ],
}
RULES["javascript"] = RULES["typescript"]
_RULES = {name: [(re.compile(gate), family, kind, re.compile(pattern), via) for gate, family, kind, pattern, via in rules] for name, rules in RULES.items()}

# Annotations that count only where their framework is imported.
SPRING = """Controller RestController GetMapping PostMapping PutMapping DeleteMapping PatchMapping RequestMapping Bean Service Repository
Component Autowired Configuration Value Scheduled PathVariable RequestBody RequestParam ResponseBody Transactional SpringBootApplication""".split()
JUNIT = """Test Before After BeforeClass AfterClass BeforeAll AfterAll BeforeEach AfterEach Rule Ignore Disabled RunWith ExtendWith
ParameterizedTest RepeatedTest Timeout TempDir DisplayName""".split()
MOCKITO = "Mock InjectMocks Spy Captor MockBean".split()
HTTP_VERBS = "get post put delete patch head options".split()
LIFECYCLE = "Before After BeforeClass AfterClass BeforeAll AfterAll BeforeEach AfterEach".split()
MAPPINGS = "GetMapping PostMapping PutMapping DeleteMapping PatchMapping RequestMapping".split()
FLASK_HOOKS = "before_request after_request teardown_request errorhandler before_app_request after_app_request teardown_app_request teardown_appcontext".split()
# Names of factories by language, whole and as beginnings; beginnings of the methods of builders.
FACTORIES = {
    "go": ("New", "New"), "java": ("of create from valueOf getInstance copyOf parse instance newInstance builder newBuilder", ""),
    "rust": ("new default create parse make", "new_ from_"), "python": ("create make build new factory of", "create_ make_ build_ new_ from_"),
    "typescript": ("create make build new of factory", "create make build new"),
}
BUILDERS = ("set", "with", "add", "build")
# Types that make a Rust field mutable.
INNER_MUTABLE = ("Cell<", "RefCell<", "Mutex<", "RwLock<", "Atomic", "UnsafeCell<")


def imported(modules: set[str], gate: str | re.Pattern) -> bool:
    return any(re.search(gate, m) for m in modules)


def is_factory(language: str, name: str) -> bool:
    """Whether a function of this name makes things, by the habits of the language."""
    whole, begin = (x.split() for x in FACTORIES["typescript" if language == "javascript" else language])
    if name in whole:
        return True
    after = [name[len(b) :] for b in begin if name.startswith(b) and len(name) > len(b)]
    if language == "go":
        return any(x[0].isupper() for x in after)
    if language in ("typescript", "javascript"):
        return any(x[0].isupper() or x[0] == "_" for x in after)
    return bool(after)


def is_builder(name: str) -> bool:
    return name.lower().startswith(BUILDERS)


def gated(language: str, modules: set[str], text: str) -> Iterator[tuple[int, str, str, str, str | None, str]]:
    """(place, family, kind, name, owner, technology) of the rules that hold in a statement."""
    for gate, family, kind, pattern, via in _RULES[language]:
        for m in pattern.finditer(text):
            if not imported(modules, gate):
                break
            g = m.groupdict()
            yield m.start(), family, kind, "(anonymous)" if m["n"] == "func" else m["n"], g.get("o"), via or g.get("r") or ""


def annotation_counts(name: str, modules: set[str]) -> bool:
    """Annotations of frameworks count where the framework is imported, others always."""
    for names, gate in ((SPRING, r"^org\.springframework"), (JUNIT, r"^org\.junit"), (MOCKITO, r"^org\.mockito")):
        if name in names:
            return imported(modules, gate)
    return True


def join_path(*parts: str) -> str:
    """Parts of a route as one path: one slash between them, one before."""
    return "/" + "/".join(p.strip("/") for p in parts if p.strip("/"))


class GoRouters:
    """What a file's variables route: the prefix of each gin group, and mux routers."""

    _BOUND = re.compile(r"\b(?P<v>\w+)\s*(?::=|=)\s*(?:(?P<gin>gin\.(?:Default|New)\(\))|(?P<mux>mux\.NewRouter\(\))|(?P<of>\w+)\.Group\(\s*\"(?P<p>[^\"]*)\")")
    _GIVEN = re.compile(r"\b(?P<v>\w+)\s+\*(?:gin\.(?P<gin>Engine|RouterGroup)|mux\.(?P<mux>Router))\b")
    _CALLED = re.compile(r"\b(?P<v>\w+)\.(?P<m>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any|Handle|HandleFunc|Use|Get|Post|Put|Delete|Patch)\((?P<a>[^)]*)")

    def __init__(self) -> None:
        self.prefixes: dict[str, str] = {}
        self.mux: set[str] = set()

    def read(self, text: str) -> Iterator[tuple[int, str, str, str]]:
        """(place, family, kind, name) of routes, registrations and callbacks of a statement; bindings are remembered."""
        for m in [*self._GIVEN.finditer(text), *self._BOUND.finditer(text)]:
            g = m.groupdict()
            if g["gin"]:
                self.prefixes[m["v"]] = ""
            elif g["mux"]:
                self.mux.add(m["v"])
            elif g.get("of") in self.prefixes:
                self.prefixes[m["v"]] = join_path(self.prefixes[g["of"]], g["p"])
        for m in self._CALLED.finditer(text):
            strings, verb = re.findall(r"\"([^\"]*)\"", m["a"]), m["m"]
            if m["v"] in self.prefixes and verb == "Use":
                for handler in re.findall(r"[\w.]+(?=\s*(?:\(|,|$))", m["a"]):
                    yield m.start(), "callback", "middleware", handler
            elif m["v"] in self.prefixes and strings:
                method, path = (strings[0], strings[1]) if verb == "Handle" and len(strings) > 1 else (verb, strings[0])
                name = f"{method.upper()} {join_path(self.prefixes[m['v']], path)}"
                yield m.start(), "route", "http", name
                yield m.start(), "registration", "route", name
            elif m["v"] in self.mux and verb == "HandleFunc" and strings:
                yield m.start(), "route", "http", f"ANY {strings[0]}"
                yield m.start(), "registration", "route", strings[0]
            elif m["v"] != "http" and verb not in ("Use", "Any") and strings and strings[0].startswith("/"):
                yield m.start(), "route", "http", f"{'ANY' if verb.startswith('Handle') else verb.upper()} {strings[0]}"


def clap_flags(text: str) -> Iterator[tuple[int, str]]:
    """(place, flag) of the arguments that a chain of builders adds."""
    if "Arg::new" in text:
        for m in re.finditer(r"\.(long|short)\(\s*[\"'](\w[\w-]*)[\"']", text):
            yield m.start(), f"{'--' if m[1] == 'long' else '-'}{m[2]}"


def spring_route(marks: list[tuple[str, str]], prefix: str) -> str | None:
    """METHOD path of a method's mapping annotations below its class's path."""
    for name, text in marks:
        if name in MAPPINGS:
            path = re.search(r"\"([^\"]*)\"", text)
            method = re.search(r"RequestMethod\.(\w+)", text)
            verb = (method[1] if method else "ANY") if name == "RequestMapping" else name.removesuffix("Mapping").upper()
            return f"{verb} {join_path(prefix, path[1] if path else '')}"
    return None
