"""What the scan must find in the corpus, written down by statement and not computed from text.

Each entry belongs to one statement of `codelode.sources.corpus`. Lines count from 0 within the
statement. A column that stands behind the user id is given with `U`, which adds its length.
"""

from __future__ import annotations

U = 1_000_000  # added to a column: shift it by the length of the user id

S, V, X = "STRING", "VARIABLE", "UNKNOWN"
PY, JA, JS = 0, 1, 2

# (language, statement): [(line, column, variable, kind, text)]
ASSIGNMENTS = {
    (PY, 0): [(0, 1, "password", S, "pw-{u}-secret")],
    (PY, 1): [(0, 1, "token", X, "load_token({u})")],
    (PY, 2): [(0, 1, "pwd", S, "abc")],
    (PY, 3): [(0, 1, "greeting", S, "hello {u} world")],
    (PY, 4): [(0, 1, "API_KEY", S, "key-{u}-live")],
    (PY, 6): [(0, 1, "user", X, 'login = "root-{u}"'), (0, 8, "login", S, "root-{u}")],
    (PY, 8): [(0, 1, "x", S, "é")],
    (PY, 18): [(0, 11, "secret", S, "s3cr3t-{u}")],
    (PY, 20): [(0, 1, "credentials", X, '("user", "pass{u}")')],
    (PY, 22): [(0, 1, "data", S, '""\npassword = "inner"\neval(x)\n""')],
    (PY, 23): [(0, 1, "msg", S, 'f"{eval(code)} {d["k"]}"')],
    (PY, 24): [(0, 11, "password", S, "secret-{u}")],
    (JA, 0): [(0, 8, "password", S, "pw-{u}-secret")],
    (JA, 1): [(0, 8, "token", X, "readToken({u})")],
    (JA, 2): [(0, 8, "pwd", S, "abc")],
    (JA, 3): [(0, 8, "greeting", S, "hello {u} world")],
    (JA, 4): [(0, 31, "API_KEY", S, "key-{u}-live")],
    (JA, 6): [(0, 1, "user", X, 'login = "root-{u}"'), (0, 8, "login", S, "root-{u}")],
    (JA, 14): [(0, 6, "line", X, "reader.readLine()"), (0, 43, "key", S, "suffix-{u}")],
    (JA, 16): [(0, 8, "o", X, "new Function(code)")],
    (JA, 18): [(0, 48 + U, "secret", S, "s3cr3t-{u}")],
    (JA, 20): [(0, 10, "credentials", X, '{"user", "pass{u}"}')],
    (JA, 22): [(0, 8, "data", S, '""\n    password = "inner"; eval(x);\n    ""')],
    (JA, 24): [(0, 8, "s", X, '"é" + run("{u}")')],
    (JA, 26): [(0, 8, "p", X, 'factory.password("x").create(y)')],
    (JA, 29): [(0, 11, "m", X, "new HashMap<A, B>()")],
    (JS, 0): [(0, 7, "password", S, "pw-{u}-secret")],
    (JS, 1): [(0, 5, "token", X, "loadToken({u})")],
    (JS, 2): [(0, 5, "pwd", S, "abc")],
    (JS, 3): [(0, 7, "greeting", S, "hello {u} world")],
    (JS, 4): [(0, 5, "count", X, "1"), (0, 16, "apiKey", S, "key-{u}-live")],
    (JS, 6): [(0, 1, "user", X, 'login = "root-{u}"'), (0, 8, "login", S, "root-{u}")],
    (JS, 16): [(0, 7, "f", X, "new Function(code)")],
    (JS, 18): [(0, 43 + U, "secret", S, "s3cr3t-{u}")],
    (JS, 19): [(0, 7, "run", X, '(command, password = "d{u}") => command')],
    (JS, 20): [(0, 7, "credentials", X, '["user", "pass{u}"]')],
    (JS, 25): [(0, 1, "t", X, "`${a(`${b({ c: `${d(e)}` })}`)}`")],
    (PY, 30): [(0, 1, "total", X, "price * (1 + rate)")],
    (JA, 30): [(0, 5, "total", X, "price * (1 + rate)")],
    (JS, 30): [(0, 5, "total", X, "price * (1 + rate)")],
    (JS, 27): [(0, 7, "z", X, "a++ / 2"), (0, 35, "w", X, "c / d")],
    (JS, 28): [(0, 32, "n", X, "<p title=\"it's\">don't {eval(q)}</p>")],
}

# (language, statement): [(line, column, qualifier, name, [(kind, text)])]
CALLS = {
    (PY, 1): [(0, 9, None, "load_token", [(X, "{u}")])],
    (PY, 7): [(0, 1, None, "eval", [(V, "user_input")])],
    (PY, 8): [(0, 11, "builtins", "exec", [(V, "payload")])],
    (PY, 9): [
        (0, 1, "re", "compile", [(S, 'r"[a-z]+"')]),
        (0, 1, 're.compile(r"[a-z]+")', "match", [(V, "line")]),
    ],
    (PY, 10): [(0, 1, "os", "system", [(S, "ls -la")])],
    (PY, 11): [(0, 1, "os", "system", [(S, 'f"rm -rf {target}"')])],
    (PY, 12): [(0, 1, "os", "popen", [(V, "command"), (S, "r")])],
    (PY, 13): [(0, 1, "subprocess", "run", [(X, '"ls" "-la"')])],
    (PY, 14): [(0, 1, None, "eval", [(X, 'password="TopSecret"')])],
    (PY, 15): [(0, 1, "subprocess", "Popen", [(X, "# start it"), (V, "args")])],
    (PY, 17): [
        (0, 1, None, "print", [(X, 'eval("1 + {u}")'), (X, "len(os.environ)")]),
        (0, 7, None, "eval", [(S, "1 + {u}")]),
        (0, 21 + U, None, "len", [(X, "os.environ")]),
    ],
    (PY, 23): [(0, 10, None, "eval", [(V, "code")])],
    (PY, 25): [(0, 1, "os", "system", [(S, 'f"{opts["cmd"]}"')])],
    (PY, 26): [
        (0, 1, None, "say", [(S, 'f"{level:>{width(3)}} {run(f"{eval(z)}")}"')]),
        (0, 16, None, "width", [(X, "3")]),
        (0, 28, None, "run", [(S, 'f"{eval(z)}"')]),
        (0, 35, None, "eval", [(V, "z")]),
    ],
    (PY, 27): [(0, 1, None, "f", []), (0, 1, None, "f()", [(V, "x")])],
    (PY, 28): [(0, 1, None, "handlers[0]", [(S, "go{u}")])],
    (PY, 29): [(0, 1, None, "say", [(S, 'f"{eval(b)}"'), (S, 'f"{{"')]), (0, 8, None, "eval", [(V, "b")])],
    (JA, 1): [(0, 16, None, "readToken", [(X, "{u}")])],
    (JA, 7): [(0, 8, "engine", "eval", [(V, "code")])],
    (JA, 8): [
        (0, 18, "Runtime", "getRuntime", []),
        (0, 31, "Runtime.getRuntime", "exec", [(V, "command")]),
    ],
    (JA, 9): [
        (0, 9, "Pattern", "compile", [(S, "[a-z]+")]),
        (0, 27, "Pattern.compile", "matcher", [(V, "line")]),
        (0, 41, "Pattern.compile.matcher", "matches", []),
    ],
    (JA, 10): [(0, 9, "runtime", "exec", [(S, "ls -la")])],
    (JA, 11): [(0, 16, "ProcessBuilder", "start", [(X, "'c'"), (V, "name")])],
    (JA, 12): [(0, 8, "helper", "spawn", [(V, "command"), (S, "r")])],
    (JA, 13): [(0, 7, "shell", "execSync", [(X, '"ls" + flag')])],
    (JA, 14): [(0, 20, "reader", "readLine", [])],
    (JA, 15): [(0, 1, None, "exec", [(X, "// run it"), (V, "command")])],
    (JA, 17): [
        (0, 12, "System.out", "println", [(X, 'engine.eval("1 + {u}")'), (X, "size(a.b)")]),
        (0, 27, "engine", "eval", [(S, "1 + {u}")]),
        (0, 41 + U, None, "size", [(X, "a.b")]),
    ],
    (JA, 23): [
        (0, 3, "x", "a", [(V, "b")]),
        (0, 8, "x.a", "c", [(V, "d")]),
        (0, 13, "x.a.c", "e", [(V, "f")]),
        (0, 18, "x.a.c.e", "exec", [(V, "cmd")]),
    ],
    (JA, 24): [(0, 19, None, "run", [(S, "{u}")])],
    (JA, 25): [(0, 19, "eval", "run", [(V, "cmd")])],
    (JA, 26): [
        (0, 20, "factory", "password", [(S, "x")]),
        (0, 34, "factory.password", "create", [(V, "y")]),
    ],
    (JA, 27): [(0, 1, None, "f", [(X, "new HashMap<String, List<A>>()"), (S, "x{u}")])],
    (JA, 28): [(0, 9, "this", "exec", [(V, "cmd")]), (0, 31, None, "eval", [(V, "c")])],
    (JA, 29): [(1, 6, "a", "f", [(V, "b")]), (2, 6, "a.f", "g", [(V, "c")])],
    (JS, 1): [(0, 13, None, "loadToken", [(X, "{u}")])],
    (JS, 7): [(0, 1, "window", "eval", [(V, "userInput")])],
    (JS, 8): [
        (0, 10, None, "require", [(S, "child_process")]),
        (0, 10, "require('child_process')", "exec", [(V, "command")]),
    ],
    (JS, 9): [(0, 1, "/ab+c/", "exec", [(V, "line")])],
    (JS, 10): [(0, 1, "child_process", "exec", [(S, "ls -la")])],
    (JS, 11): [(0, 1, None, "exec", [(X, "`rm -rf ${target}`")])],
    (JS, 12): [(0, 1, "cp", "spawn", [(V, "command"), (S, "r")])],
    (JS, 13): [(0, 1, "child", "execSync", [(X, '"ls" + flag')])],
    (JS, 15): [(0, 1, None, "exec", [(X, "// run it"), (V, "command"), (X, "// last")])],
    (JS, 17): [
        (0, 1, "console", "log", [(X, 'eval("1 + {u}")'), (X, "size(a.b)")]),
        (0, 13, None, "eval", [(S, "1 + {u}")]),
        (0, 27 + U, None, "size", [(X, "a.b")]),
    ],
    (JS, 22): [(0, 29 + U, None, "load", [(V, "opts")])],
    (JS, 23): [
        (0, 9, "/`/", "test", [(V, "line")]),
        (0, 25, None, "eval", [(X, "`a${exec(cmd)}`")]),
        (0, 34, None, "exec", [(V, "cmd")]),
    ],
    (JS, 24): [(0, 20, None, "mixin", [(V, "Base")])],
    (JS, 25): [
        (0, 8, None, "a", [(X, "`${b({ c: `${d(e)}` })}`")]),
        (0, 13, None, "b", [(X, "{ c: `${d(e)}` }")]),
        (0, 23, None, "d", [(V, "e")]),
    ],
    (JS, 26): [(0, 1, None, "run", [(X, "tag`x${1}`"), (X, "`y`")])],
    (JS, 27): [(0, 20, None, "eval", [(V, "p")])],
    (JS, 28): [(0, 15, None, "exec", [(V, "cmd")]), (0, 59, None, "eval", [(V, "q")])],
    (JS, 29): [
        (0, 1, None, "f", []),
        (0, 1, None, "f()", [(V, "x")]),
        (0, 9, None, "a[0]", [(V, "y")]),
        (0, 18, None, "(g)", [(V, "h")]),
    ],
}

# (language, statement): [(rule, line, column, name in the description)]
FINDINGS = {
    (PY, 0): [("GEN001", 0, 1, "password")],
    (PY, 4): [("GEN001", 0, 1, "API_KEY")],
    (PY, 6): [("GEN001", 0, 8, "login")],
    (PY, 7): [("GEN002", 0, 1, "eval")],
    (PY, 8): [("GEN002", 0, 11, "builtins.exec"), ("GEN003", 0, 11, None)],
    (PY, 9): [("GEN002", 0, 1, "re.compile")],
    (PY, 12): [("GEN003", 0, 1, None)],
    (PY, 13): [("GEN003", 0, 1, None)],
    (PY, 14): [("GEN002", 0, 1, "eval")],
    (PY, 15): [("GEN003", 0, 1, None)],
    (PY, 17): [("GEN002", 0, 7, "eval")],
    (PY, 18): [("GEN001", 0, 11, "secret")],
    (PY, 23): [("GEN002", 0, 10, "eval")],
    (PY, 24): [("GEN001", 0, 11, "password")],
    (PY, 26): [("GEN002", 0, 35, "eval")],
    (PY, 29): [("GEN002", 0, 8, "eval")],
    (JA, 0): [("GEN001", 0, 8, "password")],
    (JA, 4): [("GEN001", 0, 31, "API_KEY")],
    (JA, 6): [("GEN001", 0, 8, "login")],
    (JA, 7): [("GEN002", 0, 8, "engine.eval")],
    (JA, 8): [("GEN003", 0, 31, None)],
    (JA, 9): [("GEN002", 0, 9, "Pattern.compile")],
    (JA, 11): [("GEN003", 0, 16, None)],
    (JA, 12): [("GEN003", 0, 8, None)],
    (JA, 13): [("GEN003", 0, 7, None)],
    (JA, 14): [("GEN001", 0, 43, "key")],
    (JA, 15): [("GEN003", 0, 1, None)],
    (JA, 17): [("GEN002", 0, 27, "engine.eval")],
    (JA, 18): [("GEN001", 0, 48 + U, "secret")],
    (JA, 23): [("GEN003", 0, 18, None)],
    (JA, 28): [("GEN003", 0, 9, None), ("GEN002", 0, 31, "eval")],
    (JS, 0): [("GEN001", 0, 7, "password")],
    (JS, 4): [("GEN001", 0, 16, "apiKey")],
    (JS, 6): [("GEN001", 0, 8, "login")],
    (JS, 7): [("GEN002", 0, 1, "window.eval")],
    (JS, 8): [("GEN003", 0, 10, None)],
    (JS, 9): [("GEN003", 0, 1, None)],
    (JS, 11): [("GEN003", 0, 1, None)],
    (JS, 12): [("GEN003", 0, 1, None)],
    (JS, 13): [("GEN003", 0, 1, None)],
    (JS, 15): [("GEN003", 0, 1, None)],
    (JS, 17): [("GEN002", 0, 13, "eval")],
    (JS, 18): [("GEN001", 0, 43 + U, "secret")],
    (JS, 23): [("GEN002", 0, 25, "eval"), ("GEN003", 0, 34, None)],
    (JS, 27): [("GEN002", 0, 20, "eval")],
    (JS, 28): [("GEN003", 0, 15, None), ("GEN002", 0, 59, "eval")],
}
# Calls that the custom rule of the `custom_rule` query reports.
DEBUG_OUTPUT = {(PY, 17): [(0, 1)], (JA, 17): [(0, 12)], (JS, 17): [(0, 1)]}
