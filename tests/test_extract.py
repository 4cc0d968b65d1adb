"""Facts of source files by language: statements, declarations, frameworks, and what becomes of them in the graph."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.engine import Engine
from factloom.sources import extract
from factloom.sources import frameworks as fw
from factloom.sources.statements import statements

GO = """package api
import (
	"net/http"
	"github.com/gin-gonic/gin"
	"github.com/nats-io/nats.go"
)
type Cart struct {
	Owner, Buyer string `json:"owner"`
}
func (c *Cart) WithOwner(o string) *Cart { return c.check(o) }
func (c *Cart) check(o string) *Cart { return c }
func NewCart() *Cart { return nil }
func setup(bus *nats.Conn) {
	r := gin.New()
	v1 := r.Group("/v1")
	v2 := v1.Group("beta")
	v2.GET(
		"/carts", listCarts,
	)
	r.Use(logAll)
	http.HandleFunc("/old", old) // not a route: r.GET("/no", x)
	if ready {
		bus.Subscribe("carts.paid", paid)
	}
}
"""
JAVA = """package shop;
import org.springframework.web.bind.annotation.*;
import org.springframework.kafka.annotation.KafkaListener;
import org.junit.Before;
@RestController
@RequestMapping("/shop")
public class Shop {
    private final Store store;
    int visits = 0;
    public Shop(Store store) { this.store = store; }
    @PostMapping(value = {"/buy"})
    @Retryable(attempts = 3)
    public String buy(
            String id) {
        return store.take(id);
    }
    @KafkaListener(topics = "paid")
    void paid(String m) { this.buy(m); }
    @Before
    public void open() {}
    public static Shop create() { return new Shop(null); }
    public Shop withStore(Store s) {
        return this;
    }
}
"""
TS = """import {
  z,
} from 'zod'
import express from 'express'
import { Worker } from 'bullmq'
import { useState } from 'react'
const Base = z.object({ id: z.string() })
const Item = Base.extend({
  name: z.string() })
export class Shelf {
  private readonly name = "a"
  size: number = 0
  constructor(private db: Db) {}
  load(
    id: string,
  ): void {
    Item.parse(id)
    for (const x of this.rows()) { keep(x) }
  }
  rows() { return [] }
}
const app = express()
app.use(express.json())
app.get('/items', list)
new Worker('mail', run)
export function View() {
  const [open, setOpen] = useState(false)
  return "call(this)" // and(not.this)
}
@Controller('users')
export class Users {
  @Get(':id')
  one() {}
}
@Module({
  controllers: [Users],
})
export class App {}
"""
RUST = """use serde::{Deserialize, Serialize};
use clap::{Arg, Command};
use axum::Router;
#[derive(Clone, Serialize)]
pub struct Base { }
#[derive(Deserialize)]
pub struct User {
    #[serde(flatten)]
    base: Option<Base>,
    seen: Mutex<u32>,
}
impl User {
    pub fn new<'a>(x: &'a str) -> Self { Self::check(x) }
    fn check(x: &str) -> Self { todo!() }
    pub fn with_name(self, n: char) -> Self { self }
}
#[retry(times = 3)]
fn load(text: &str) -> User { serde_json::from_str::<User>(text).unwrap() }
fn cli() {
    Command::new("tool")
        .arg(Arg::new("port").long("port").short('p'))
        .subcommand(Command::new("serve"));
    let app = Router::new().route("/health", get(health)).layer(Trace::new());
}
"""
PYTHON = """from fastapi import FastAPI
from pydantic import BaseModel
from celery import shared_task
import config
class Item(BaseModel):
    name: str
    size = 1
class Big(Item):
    @field_validator("name")
    def check(cls, v): return v
    @classmethod
    def from_text(cls, t): return cls.model_validate(t)
    def with_name(self, n):
        self.name = n
        return self
app = FastAPI()
@app.get("/items")
@retry(times=2)
def items():
    Big.model_validate({})
    return config.LIMIT
def create_app():
    app.include_router(router)
    @app.on_event("startup")
    def begin(): pass
@click.command()
@click.option("-n", "--number")
def run(): settings.get("depth")
"""


def facts(language, text):
    return {(r[0], r[1], r[2], r[5]) for r in extract.extract("f", language, text)}


def details(language, text, family):
    return {(r[5], r[1]): json.loads(r[6]) for r in extract.extract("f", language, text) if r[0] == family}


def test_go():
    got = facts("go", GO)
    assert {("route", "GET /v1/beta/carts", "http", "setup"), ("registration", "GET /v1/beta/carts", "route", "setup"), ("callback", "logAll", "middleware", "setup"), ("callback", "old", "handler", "setup")} <= got
    assert {("store", "carts.paid", "subscribe", "setup"), ("state", "Owner", "field", "Cart"), ("state", "Buyer", "field", "Cart"), ("schema", "Cart", "tag", ""), ("registration", "Cart", "builder", "Cart"), ("factory", "NewCart", "function", "")} <= got
    assert not [x for x in got if x[0] == "route" and ("/old" in x[1] or "/no" in x[1])]
    calls = details("go", GO, "call")
    assert calls["Cart.WithOwner", "check"]["receiver"] == "self" and calls["setup", "Subscribe"]["block"] == "branch"
    assert {("import", m, "module", "") for m in ("net/http", "github.com/gin-gonic/gin")} <= got


def test_java():
    got = facts("java", JAVA)
    assert {("route", "POST /shop/buy", "annotation", "Shop.buy"), ("registration", "Shop.buy", "route", "Shop"), ("store", "paid", "subscribe", "Shop.paid"), ("callback", "Shop.open", "lifecycle", "Shop"), ("retry", "Shop.buy", "Retryable", "Shop.buy")} <= got
    assert {("registration", "Shop", "factory", "Shop"), ("registration", "Shop", "builder", "Shop"), ("annotation", "RestController", "annotation", "Shop"), ("symbol", "Shop", "method", "Shop")} <= got
    fields = details("java", JAVA, "state")
    assert not fields["Shop", "store"]["mutable"] and fields["Shop", "visits"]["mutable"] and len(fields) == 2
    assert details("java", JAVA, "call")["Shop.paid", "buy"]["receiver"] == "self"
    bare = JAVA.replace("import org.springframework.web.bind.annotation.*;", "").replace("import org.springframework.kafka.annotation.KafkaListener;", "")
    assert not [x for x in facts("java", bare) if x[1] in ("RestController", "Shop.buy") and x[0] in ("annotation", "registration")]


def test_typescript():
    got = facts("typescript", TS)
    assert {("composition", "Base", "extends", "Item"), ("validation", "Item", "parse", "Shelf.load"), ("schema", "Base", "zod", ""), ("reactive", "open", "state", "View"), ("store", "mail", "subscribe", "")} <= got
    assert {("registration", "express.json", "middleware", "app"), ("registration", "GET /items", "route", "app"), ("registration", "Users", "controllers", "App"), ("route", "GET /users/:id", "decorator", "Users.one")} <= got
    assert {("symbol", "load", "method", "Shelf"), ("symbol", "constructor", "method", "Shelf"), ("import", "zod", "module", "")} <= got
    fields, calls = details("typescript", TS, "state"), details("typescript", TS, "call")
    assert fields["Shelf", "name"] == {"mutable": False} and fields["Shelf", "size"]["mutable"]
    assert calls["Shelf.load", "rows"]["receiver"] == "self" and calls["Shelf.load", "keep"]["block"] == "loop"
    assert not [k for k in calls if k[1] in ("call", "and", "not")]


def test_rust():
    got = facts("rust", RUST)
    assert {("composition", "Base", "flatten", "User"), ("validation", "User", "deserialize", "load"), ("schema", "User", "serde", ""), ("annotation", "Clone", "derive", "Base"), ("retry", "load", "retry", "load")} <= got
    assert {("cli", "--port", "flag", "cli"), ("cli", "-p", "flag", "cli"), ("cli", "serve", "subcommand", "cli"), ("registration", "/health", "route", "cli"), ("registration", "Trace", "middleware", "cli")} <= got
    assert {("registration", "User", "factory", "User"), ("registration", "User", "builder", "User"), ("symbol", "new", "method", "User"), ("failure", "unwrap", "unwrap", "load")} <= got
    fields = details("rust", RUST, "state")
    assert not fields["User", "base"]["mutable"] and fields["User", "seen"]["mutable"]
    assert details("rust", RUST, "call")["User.new", "check"]["receiver"] == "self"


def test_python():
    got = facts("python", PYTHON)
    assert {("registration", "GET /items", "route", "items"), ("retry", "items", "retry", "items"), ("validation", "Big", "model_validate", "items"), ("validation", "Big", "validator", "Big.check"), ("composition", "Item", "inherits", "Big")} <= got
    assert {("registration", "Big", "factory", "Big"), ("registration", "Big", "builder", "Big"), ("registration", "router", "include_router", "create_app"), ("callback", "startup", "lifecycle", "create_app.begin")} <= got
    assert {("config", "LIMIT", "setting", "items"), ("config", "depth", "setting", "run"), ("cli", "-n", "flag", "run"), ("cli", "--number", "flag", "run"), ("state", "name", "field", "Item"), ("state", "size", "field", "Item"), ("state", "name", "field", "Big")} <= got
    assert not [x for x in facts("python", PYTHON.replace("from fastapi import FastAPI\n", "")) if x[0] in ("callback",) or x[1] == "app.get"]


def test_names():
    assert [fw.is_factory(*x) for x in (("go", "NewX"), ("go", "Newest"), ("java", "of"), ("rust", "from_x"), ("python", "make_x"), ("typescript", "createApp"), ("javascript", "creates"))] == [True, False, True, True, True, True, False]
    assert fw.join_path("", "/") == "/" and fw.join_path("/a/", "/b") == "/a/b"


@pytest.mark.parametrize("language", ["go", "java", "typescript", "rust"])
@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet="ab.(){}[]\"'`/*\n\\ @#=:;r", max_size=80))
def test_any_text_is_read(language, text):
    found = list(statements(language, text))
    assert all(len(s.text) == len(s.bare) or not s.text.endswith(tuple("\"'`")) for s in found)
    lines = [s.line for s in found]
    assert lines == sorted(lines) and all(1 <= n <= text.count("\n") + 1 for n in lines)
    extract.extract("f", language, text)


def test_long_statements_are_read_in_time():
    rows = ",\n".join(f'  f{i}("a", [{i}, g(x)])' for i in range(30_000))
    assert len(extract.extract("f", "typescript", f"const t = [\n{rows}\n]\n")) == 60_001
    assert sum(1 for _ in statements("go", f"var t = f(\n{rows},\n)\n")) == 1


def test_facts_become_edges(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    for name, text in {"a.go": GO, "S.java": JAVA, "t.ts": TS, "u.rs": RUST, "p.py": PYTHON}.items():
        (root / name).write_text(text)
    e = Engine(spark, str(tmp_path / "facts"))
    e.index(str(root))
    got = {(r["subject"], r["predicate"], r["object"]) for r in e.table("edges").collect()}
    assert ("symbol:a.go#setup", "registers", "contract:GET /v1/beta/carts") in got
    assert ("symbol:S.java#Shop", "registers", "symbol:S.java#Shop.buy") in got
    assert ("symbol:S.java#Shop", "handles_callback", "symbol:S.java#Shop.open") in got
    assert ("symbol:a.go#setup", "handles_callback", "unknown:logAll") in got
    assert ("schema:u.rs#User", "composes", "schema:u.rs#Base") in got and ("symbol:u.rs#load", "validates", "schema:u.rs#User") in got
    assert ("annotation:Clone", "annotates", "symbol:u.rs#Base") in got
    assert ("symbol:t.ts#Shelf", "contains", "field:t.ts#Shelf.name") in got
    assert ("symbol:t.ts#Shelf.load", "calls", "symbol:t.ts#Shelf.rows") in got
    kinds = {r["id"]: (r["kind"], r["attributes"]) for r in e.table("entities").collect()}
    assert kinds["contract:GET /v1/beta/carts"][0] == "contract" and json.loads(kinds["field:t.ts#Shelf.name"][1]) == {"mutable": False, "owner": "Shelf"}
    assert e.verify().filter("kind = 'dangling'").count() == 0
