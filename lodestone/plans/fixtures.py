"""Inline inputs of queries whose kind of text no table holds."""

FTS_QUERIES = [
    (0, "thing, tion and then ther"),
    (1, "thing edble"),
    (2, "zqx unknown wordless"),
    (3, "threlyes_ofthstthor auth"),
    (4, "ourThing with eres oner"),
    (5, "how is it"),
]

SENTENCES = [
    (0, "function signInWithGoogle(provider) { return user_auth_token; }"),
    (1, "how does signInWithGoogle use the user_auth_token"),
    (2, "the quick brown fox"),
    (3, "HTTPServer parseHTTPResponse _private __init__ x_ aB"),
    (4, "auth login config db"),
    (5, "is it and the or"),
    (6, ""),
    (7, "getUserById getUserById user_id api middleware"),
    (8, "Überprüfung naïveCase wordÉtat some_thing"),
    (9, "isNot doIt of_the then_ifElse"),
]

PATHS = [
    ("README.md", 900), ("docs/guide.md", 900), ("src/auth.ts", 900), ("src/auth.test.ts", 900), ("package.json", 900), ("src/.env", 10),
    ("a/__tests__/x.js", 5), ("a/test/x.py", 512000), ("a/test/y.py", 512001), ("node_modules/x.js", 5), ("a/node_modules/x.js", 5), ("x.min.js", 5),
    ("a/b.min.js", 5), (".github/x.ts", 5), ("src\\win.ts", 5), ("dist/a/b.go", 5), ("conf/app.yml", 5), ("Makefile", 5), ("src/A.JAVA", 5),
    ("lib/x.rb", None), ("yarn.lock", 5), ("db/schema.sql", 5), ("x.test.tar.py", 5), ("a.b/c", 5),
]

DIRECTORIES = [
    ("/", [], []), ("/home", [], []), ("/home/ann", [], []), ("/home/ann/code", [], []), ("/home/ann/code/x", [], ["/home/ann/code"]),
    ("/home/ann/code2", [], ["/home/ann/code"]), ("/home/ann/code/x/y", ["/home/ann/code/x"], ["/home/ann/code"]), ("/home/ann", ["/home/ann"], []), ("/opt", [], ["/opt"]),
]

REQUESTS = [
    (0, "abc", "", "files_with_matches", False), (1, "getUser", "", "files_with_matches", False), (2, "user auth flow", "", "files_with_matches", False),
    (3, "foo.*bar", "", "files_with_matches", False), (4, "getUser", "src/a.ts", "files_with_matches", False), (5, "getUser", "", "count", False),
    (6, "fs.readFile", "", "files_with_matches", False), (7, "src/lib", "", "files_with_matches", False), (8, "getUser", "", "content", False),
    (9, "getUser", "", "content", True), (10, '"exact"', "", "files_with_matches", False), (11, "TODO later", "", "files_with_matches", False),
    (12, "localhost", "", "files_with_matches", False), (13, "getUser", "node_modules/lib", "files_with_matches", False), (14, "getUser", "src/", "files_with_matches", False),
    (15, "getUser", "./dist", "files_with_matches", False), (16, None, "", "content", True), (17, "getUser", "a/b.v2/", "files_with_matches", False),
]

COMMANDS = [
    (0, "grep -rn getUser src"), (1, "ls | grep foo"), (2, "rg 'two words' lib | head"), (3, "grep -c foo x"), (4, 'ag "quoted"'), (5, "rg -l foo"), (6, "cat x"), (7, "  ack needle"), (8, "rg"),
    (9, "grep --include=*.ts needle src lib"), (10, "grep -v"),
]

CODE = [
    ("src/auth.ts", """import { Token, sign as makeSign } from './token';

// Signs a user in.
// Two lines of it.
export async function signIn(user: User) {
  const t = makeToken(user.id);
  return session.start(t);
}

/** A session. */
export class Session {
  open(name) {
    return new Connection(name);
  }
}

const helper = (a, b) => combine(a, b);
export const LIMITS = { one: 1 };
type Pair = [string, string];
"""),
    ("src/use.js", """import { signIn } from './auth';
const text = "call(me)"; // later(on)
function main() {
  signIn(currentUser());
  if (ready) { log("x"); }
}

class App {
  run() { main(); }
}
"""),
    ("py/tool.py", '''"""Module doc with fake(call)."""
import os

@decorated
def load(path):
    # comment(here)
    return parse(open(path))


class Loader:
    def run(self):
        return load("x")
'''),
    ("go/main.go", "package main\n\ntype Server struct {}\n\nfunc (s *Server) Start() error {\n\treturn listen(s.addr)\n}\n"),
    ("rs/lib.rs", "pub struct Config {}\nimpl Config {\n    pub fn load() -> Config { read_config() }\n}\npub(crate) fn helper() {}\nmod inner {}\n"),
    ("J.java", "public class J {\n  private static int count(String s) { return s.length(); }\n}\ninterface K {}\n"),
    ("r.rb", "module M\n  class C\n    def self.make(x)\n      build(x)\n    end\n    def ok?\n    end\n  end\nend\n"),
    ("p.php", "<?php\nabstract class P {\n  public static function run($x) { return go_on($x); }\n}\ntrait T {}\n"),
    ("c.c", "#include <x.h>\nstruct node { int v; };\nstatic int add(int a, int b) {\n  return sum2(a, b);\n}\n"),
    ("m.sql", "-- ===\nCREATE TABLE IF NOT EXISTS users (id int);\n\n-- note\nALTER TABLE users ADD x int;\nSELECT 1;\n"),
    ("note.md", "# Title\ncall(me)\n"),
    ("empty.py", ""),
]
