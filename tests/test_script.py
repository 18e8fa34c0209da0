from grafloom.operators.extract import Found
from grafloom.operators.script import ScriptFile, module_of

APP = r"""#!/usr/bin/env node
import React, { useState as us, useMemo } from 'react';
import * as util from "./utils.js";
import './theme.css';
export { x } from './lib/index';
export * from "../other";
const fs = require('fs'), part = require('./part').one;
let { a } = require("./b");

/* it's "quoted" */
const rate = total / 2, re = /[/'"]\/(x)/g.test(total / 3);

export default function main(argv, { flag } = pick()) {
  const inner = async (x) => util.go(x, `t ${fmt(x)} it's`);
  function nested() { return this.run?.(1) }
  if (flag) { function hidden() { quiet() } loud() }
  new Engine(1);
  new Engine().start();
  list.map(v => one(v)).filter(function (v) { return two(v) });
  return super_(argv);
}

(function () {
  function gridOf(t) { return t.closest("table") }
  document.addEventListener("click", () => { function toggle() { gridOf(1) } helper(toggle) });
})();

class Engine extends base.Motor {
  static #count = init();
  handler = () => never();
  get size() { return measure(this) }
  async *['x' + 1]() { }
  constructor(a, b) { super(a); super.boot(b); const f = import('./lazy.mjs') }
}
const Named = class extends Engine { go() { stop() } };
const View = ({ name }) => (
  <div className="a" onClick={() => clicked(name)}>
    Don't count me (now) {show(name)} <b>{us(1)}</b><br/>
  </div>
)
var obj = { m(a) { deep(a) }, n: function () { deeper() }, class: 1 }
export const last = obj.m
[1, 2].forEach(last)
"""

TYPES = """import type { Shape } from '@/shape'
import { type Box, Runnable } from './types'
export interface Mover<T> extends Runnable, ns.Thing<T> { go(): void }
export abstract class Car<T extends { a: number }> extends Base<T> implements Mover<T>, Runnable {
  private wheels: Map<string, number> = make<Map<string, number>>(4)
  constructor(private readonly x: number) { super() }
  @deco({ a: 1 })
  public async drive<U>(to: U, opts?: { fast: boolean }): Promise<{ ok: boolean }> { return this.x!.turn(to as any) }
  abstract stop(): void
}
export const plan = async <T,>(x: T): Promise<T> => { await work(x); return x }
const cb: (n: number) => void = (n) => log(n)
declare const G: string
enum Kind { A, B }
type Fn = (a: string) => void
export default (a: number) => a
"""


def read(path, text):
    out = ScriptFile(path, path.rsplit(".", 1)[0].replace("/", "."), text, Found()).out
    edges = {}
    for e in out.edges.values():
        edges.setdefault(e["edge_type"], set()).add((e["src_qname"], e["dst_raw"]))
    return out, {n["qualified_name"]: n for n in out.nodes.values()}, edges, {(b["local_name"], b["target"], b["kind"]) for b in out.imports.values()}


def test_javascript():
    _, nodes, edges, imports = read("pkg/app.js", APP)
    assert imports == {
        ("React", "react", "external"), ("us", "react", "external"), ("useMemo", "react", "external"), ("util", "pkg.utils", "module"), ("./theme.css", "pkg/theme.css", "module"),
        ("./lib/index", "pkg.lib", "module"), ("../other", "other", "module"), ("fs", "fs", "external"), ("./lazy.mjs", "pkg.lazy", "module"),
    }
    kinds = {q.removeprefix("pkg.app."): n["kind"] for q, n in nodes.items()}
    assert kinds == {
        "main": "Function", "main.inner": "Function", "main.nested": "Function", "gridOf": "Function", "toggle": "Function", "Engine": "Class", "Engine.size": "Method", "Engine.['x' + 1]": "Method",
        "Engine.constructor": "Method", "Named": "Class", "Named.go": "Method", "View": "Function",
    }
    assert nodes["pkg.app.main"]["signature"] == "function main(argv, { flag } = pick())" and nodes["pkg.app.main.inner"]["signature"] == "const inner(x)" and nodes["pkg.app.Engine.size"]["signature"] == "size()"
    assert (nodes["pkg.app.main"]["start_line"], nodes["pkg.app.main"]["end_line"], nodes["pkg.app.View"]["end_line"]) == (13, 21, 40)
    calls = {(s.removeprefix("pkg.app."), d) for s, d in edges["CALLS"]}
    chain = "list.map(v => one(v)).filter"
    assert calls == {
        ("pkg.app", "require"), ("pkg.app", "/[/'\"]\\/(x)/g.test"), ("main.inner", "util.go"), ("main.inner", "fmt"), ("main.nested", "this.run"), ("main", "quiet"), ("main", "loud"), ("main", "new Engine().start"),
        ("main", "list.map"), ("main", chain), ("main", "one"), ("main", "two"), ("main", "super_"), ("gridOf", "t.closest"), ("pkg.app", "document.addEventListener"), ("toggle", "gridOf"), ("pkg.app", "helper"),
        ("Engine", "init"), ("Engine.size", "measure"), ("Engine.constructor", "super.boot"), ("Named.go", "stop"), ("View", "clicked"), ("View", "show"), ("View", "us"), ("pkg.app", "deep"), ("pkg.app", "deeper"), ("pkg.app", "obj.m [1, 2].forEach"),
    }
    assert edges["INHERITS"] == {("pkg.app.Engine", "base.Motor"), ("pkg.app.Named", "Engine")}


def test_typescript():
    _, nodes, edges, imports = read("src/car.ts", TYPES)
    assert imports == {("Shape", "@/shape", "external"), ("Box", "src.types.Box", "symbol"), ("Runnable", "src.types.Runnable", "symbol")}
    assert {q.removeprefix("src.car."): n["kind"] for q, n in nodes.items()} == {"Mover": "Interface", "Car": "Class", "Car.constructor": "Method", "Car.drive": "Method", "plan": "Function", "cb": "Function", "default": "Function"}
    assert edges["INHERITS"] == {("src.car.Mover", "Runnable"), ("src.car.Mover", "ns.Thing"), ("src.car.Car", "Base")}
    assert edges["IMPLEMENTS"] == {("src.car.Car", "Mover"), ("src.car.Car", "Runnable")}
    assert edges["CALLS"] == {("src.car.Car", "make"), ("src.car.Car.drive", "this.x!.turn"), ("src.car.plan", "work"), ("src.car.cb", "log")}
    assert nodes["src.car.Car.drive"]["signature"] == "drive(to: U, opts?: { fast: boolean })" and nodes["src.car.default"]["signature"] == "export default default(a: number)"


def test_specifiers():
    assert [module_of("a/b.js", r) for r in ("./c", "../index.js", "../../x", "react", "/static/x.ts", "./d.json", "./", "https://x/y.js", "./e/index")] == ["a.c", "index", None, None, "static.x", "a/d.json", "a", None, "a.e"]
