"""What fingerprints hold of small files."""

from archlens.operators.fingerprints import fingerprints

RUST = '''use std::fs::{self, File};
// The parser reads tokens. Parser of "no string".
#[derive(Debug)]
pub struct Reader;
/* parser notes */
pub async fn read<T>(mut path: &Path, map: HashMap<K, V>, n: u8,) -> Result<Vec<u8>> where T: X { let a = "/etc/x // no comment"; let b = "short"; let c = 'x'; r#"SELECT "1""#; }
fn own(&self, x: u8) { "a longer string" }
'''
PYTHON = '@route("/x")\nclass Api:\n    def get(self, n: int = 3, *, url: str = "https://a") -> list[str]:\n        """A text of docs."""\n        # fetch pages\n        return x\nimport os.path\nfrom a.b import c\n'
GO = 'package x\nimport (\n  "net/http"\n  db "database/sql"\n)\n// Serve pages\nfunc Serve(w http.ResponseWriter, a, b int) error {\n}\ntype Row struct {\n  A int `json:"a"`\n}\n'
TS = "import a from './a';\nexport class Page { }\nfunction go(x: string, y?: number): Promise<void> { fetch(`https://b/${x}`); } // go on\n"


def test_fingerprints(spark):
    files = [("a.rs", RUST), ("b.py", PYTHON), ("c.go", GO), ("d.ts", TS), ("e.rs", ""), ("f.rs", None), ("g.txt", "x"), ("h.rs", '"' + "a\\\\" * 100_000 + '"')]
    found = {r["path"]: r.asDict() for r in fingerprints(spark.createDataFrame(files, "path string, content string")).collect()}
    assert sorted(found) == ["a.rs", "b.py", "c.go", "d.ts", "e.rs", "h.rs"]
    rust = found["a.rs"]
    assert rust["imports"] == ["std::fs::{self, File}"] and rust["annotations"] == ["derive(Debug)"] and rust["exports"] == ["Reader", "read"]
    assert rust["param_types"] == ["&Path", "HashMap<K, V>", "u8"] and rust["return_types"] == ["Result<Vec<u8>>"]
    assert rust["strings"] == ["/etc/x // no comment", 'SELECT "1"', "a longer string"] and "parser" in rust["comment_nouns"]
    python = found["b.py"]
    assert python["imports"] == ["a.b", "os.path"] and python["annotations"] == ['route("/x")'] and python["exports"] == ["Api"] and python["param_types"] == ["int", "str"]
    assert python["return_types"] == ["list[str]"] and python["strings"] == ["A text of docs.", "https://a"] and python["comment_nouns"] == ["fetch", "pages"]
    go = found["c.go"]
    assert go["imports"] == ["database/sql", "net/http"] and go["annotations"] == ['json:"a"'] and go["exports"] == ["Row", "Serve"] and go["param_types"] == ["http.ResponseWriter", "int"] and go["return_types"] == ["error"]
    assert found["d.ts"]["imports"] == ["./a"] and found["d.ts"]["exports"] == ["Page"] and found["d.ts"]["param_types"] == ["number", "string"] and found["d.ts"]["return_types"] == ["Promise<void>"]
    assert all(found["e.rs"][n] == [] for n in ("imports", "strings", "comment_nouns", "exports"))
