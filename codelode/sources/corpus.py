"""Code corpus derived from the `events` table.

Twenty consecutive events make one source file, each event one statement. The statement is chosen
by `event_id % 31`, the language by the number of the file, and the user id of the event stands in
the text, so that texts and columns differ from file to file. The statements cover hits, near
misses and the quirks of every rule in every language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.catalog import LANGUAGES

EVENTS_PER_FILE = 20
STATEMENTS = {
    "python": [
        'password = "pw-{u}-secret"',
        "token = load_token({u})",
        'pwd = "abc"',
        'greeting = "hello {u} world"',
        "API_KEY: str = 'key-{u}-live'",
        'self.password = "hunter-{u}"',
        'user = login = "root-{u}"',
        "eval(user_input)",
        'x = "é"; builtins.exec(payload)',
        're.compile(r"[a-z]+").match(line)',
        'os.system("ls -la")',
        'os.system(f"rm -rf {target}")',
        'os.popen(command, "r")',
        'subprocess.run("ls" "-la")',
        'eval(password="TopSecret")',
        "subprocess.Popen(  # start it\n    args,\n)",
        "spawn(x for x in jobs)",
        'print(eval("1 + {u}"), len(os.environ))',
        'if debug: secret = "s3cr3t-{u}"',
        'def run(command, password="default{u}"): pass',
        'credentials = ("user", "pass{u}")',
        '# password = "commented-{u}"',
        'data = """\npassword = "inner"\neval(x)\n"""',
        'msg = f"{eval(code)} {d["k"]}"',
        'if debug: password: str = "secret-{u}"',
        'os.system(f"{opts["cmd"]}")',
        'say(f"{level:>{width(3)}} {run(f"{eval(z)}")}")',
        "f()(x)",
        'handlers[0]("go{u}")',
        'say(f"{eval(b)}", f"{{")',
        "total = price * (1 + rate)",
    ],
    "java": [
        'String password = "pw-{u}-secret";',
        "char[] token = readToken({u});",
        'String pwd = "abc";',
        'String greeting = "hello {u} world";',
        'class K { static final String API_KEY = "key-{u}-live"; }',
        'this.password = "hunter-{u}";',
        'user = login = "root-{u}";',
        "engine.eval(code);",
        "/* é */ Runtime.getRuntime().exec(command);",
        'Pattern.compile("[a-z]+").matcher(line).matches();',
        'runtime.exec("ls -la");',
        "ProcessBuilder.start('c', name);",
        'helper.spawn(command, "r");',
        'shell.execSync("ls" + flag);',
        'if ((line = reader.readLine()) != null) { key += "suffix-{u}"; }',
        "exec( // run it\n    command\n);",
        "Object o = new Function(code);",
        'System.out.println(engine.eval("1 + {u}"), size(a.b));',
        '@Config(secret = "annotated{u}") class A { String secret = "s3cr3t-{u}"; }',
        'abstract class B { abstract void run(String command); String name() { return "n{u}"; } }',
        'String[] credentials = {"user", "pass{u}"};',
        '// String password = "commented-{u}";',
        'String data = """\n    password = "inner"; eval(x);\n    """;',
        "x.a(b).c(d).e(f).exec(cmd);",
        'String s = "é" + run("{u}"); // é',
        "if (a > 1) { eval.run(cmd); }",
        'Object p = factory.password("x").create(y);',
        'f(new HashMap<String, List<A>>(), "x{u}");',
        "this.<T>exec(cmd); if (a > b) eval(c);",
        "Map<A, B> m = new HashMap<A, B>(); a\n    .f(b)\n    .g(c);",
        "int total = price * (1 + rate);",
    ],
    "javascript": [
        'const password = "pw-{u}-secret";',
        "let token = loadToken({u});",
        "var pwd = 'abc';",
        'const greeting = "hello {u} world"',
        "let count = 1, apiKey = 'key-{u}-live';",
        'this.password = "hunter-{u}";',
        'user = login = "root-{u}";',
        "window.eval(userInput);",
        "/* é */ require('child_process').exec(command);",
        "/ab+c/.exec(line);",
        'child_process.exec("ls -la");',
        "exec(`rm -rf ${target}`);",
        "cp.spawn(command, 'r');",
        'child.execSync("ls" + flag);',
        'class Vault { password = "field-{u}-x"; open(key) { return key; } }',
        "exec(\n    // run it\n    command, // last\n);",
        "const f = new Function(code);",
        'console.log(eval("1 + {u}"), size(a.b));',
        'function check(secret = "default{u}", key) { secret = "s3cr3t-{u}"; }',
        'const run = (command, password = "d{u}") => command;',
        'const credentials = ["user", "pass{u}"];',
        '// const password = "commented-{u}";',
        'const { user = "nobody{u}" } = load?.(opts);',
        "if (ok) /`/.test(line); eval(`a${exec(cmd)}`);",
        'class Safe extends mixin(Base) { password = "field-{u}-y"; }',
        "t = `${a(`${b({ c: `${d(e)}` })}`)}`;",
        "run(tag`x${1}`, `y`); f`z`;",
        "const z = a++ / 2; eval(p); const w = c / d;",
        "b.return / 2; exec(cmd); const n = <p title=\"it's\">don't {eval(q)}</p>;",
        "f()(x); a[0](y); (g)(h);",
        "let total = price * (1 + rate);",
    ],
}
N_STATEMENTS = 31


def statements(spark: SparkSession) -> DataFrame:
    rows = [
        (number, language, extension, template, text)
        for number, (language, extension) in enumerate(LANGUAGES)
        for template, text in enumerate(STATEMENTS[language])
    ]
    return spark.createDataFrame(
        rows, "language_no int, language string, extension string, template int, statement string"
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units `(path, language, content)` made from all events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    file_no = F.floor(F.col("event_id") / EVENTS_PER_FILE)
    placed = events.withColumns(
        {
            "file_no": file_no,
            "language_no": (file_no % len(LANGUAGES)).cast("int"),
            "template": (F.col("event_id") % N_STATEMENTS).cast("int"),
        }
    )
    # 93 statements, a fixed number.
    lines = placed.join(
        F.broadcast(statements(spark)), ["language_no", "template"]
    ).withColumn(
        "text",
        F.concat(
            F.replace("statement", F.lit("{u}"), F.col("user_id").cast("string")),
            # A blank line after every fifth statement.
            F.when(F.col("event_id") % 5 == 4, F.lit("\n")).otherwise(F.lit("")),
        ),
    )
    # A group is one file of twenty events.
    return (
        lines.groupBy("file_no", "language", "extension")
        .agg(F.array_sort(F.collect_list(F.struct("event_id", "text"))).alias("parts"))
        .select(
            F.format_string("corpus/f%07d%s", "file_no", "extension").alias("path"),
            "language",
            F.array_join(F.col("parts.text"), "\n").alias("content"),
        )
    )


def altered_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with some units emptied and some damaged, by the number of the file."""
    digit = F.substring(F.regexp_extract("path", r"f(\d+)\.", 1), -1, 1)
    content = F.col("content")
    return corpus(spark, sf_dir).withColumn(
        "content",
        F.when(digit == "3", F.concat(content, F.lit("\npassword =")))
        .when(digit == "6", F.concat(content, F.lit("\nrun(")))
        .when(digit == "8", F.lit(""))
        .when(digit == "9", F.concat(content, F.lit('\n"open')))
        .otherwise(content),
    )
