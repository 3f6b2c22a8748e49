"""Word lists, needles and patterns that results depend on. They must stay as they are."""

PRUNED_DIRECTORIES = (".git", ".svn", ".hg", "node_modules", "target", "dist", "build", "out", "gen", ".venv", "venv", ".tox", "__pycache__", "coverage", "vendor", )
PRUNED_FILES = ("Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "go.sum", "Gemfile.lock")
SKIPPED_DIRECTORIES = ("spec", "examples", "fixtures")
BINARY_FILE = r"(?i)\.(png|jpg|gif|svg|ico|webp|woff2?|ttf|pdf|mp4|zip|gz|tar|exe|dll|so|dylib|class|pyc)$"
SECRET_FILE = r"(?i)(^\.?env(\..*)?$|/\.?env(\..*)?$|(^|/)(id_rsa|id_ed25519|.*\.(pem|p12|key|pfx))$)"
CODE_FILE = r"(?i)\.(rs|go|py|js|jsx|ts|tsx|java|c|cpp|h|hpp|cs|php|rb|sh|sql|html|css|scss|json|toml|yaml|md)$"
CODE_NAME = r"(?i)(Makefile|Dockerfile|CMakeLists\.txt)$"

SOURCE_EXTENSIONS = ("rs", "py", "ts", "tsx", "js", "jsx")
CONFIG_EXTENSIONS = ("toml", "yaml", "yml", "ini", "cfg", "env", "properties", "json", "jsonc")
ASSET_EXTENSIONS = ("html", "htm", "xml", "svg", "css", "scss", "sass", "less")

#: Extension -> language of the needle tables.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "cpp": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "swift": "swift"}

_SCRIPT = ("javascript", "typescript")

#: Concept -> language -> needles, sought in lower case.
NEEDLES = {
    "heap": {
        "rust": (".clone(", ".to_string(", ".to_owned(", "vec![", "string::from", "format!(", "to_vec("),
        "python": (".copy(", "list(", "dict(", "set(", "str(", "bytes(", "copy.deepcopy"),
        **dict.fromkeys(_SCRIPT, (".slice(", ".map(", ".filter(", ".concat(", "array.from(", "new map(", "new set(")),
        "go": ("append(", "make([]", "make(map[", "string("),
        "cpp": ("std::string", "std::vector", "std::map", "std::set"),
        "swift": ("array(", "dictionary(", "set(", "string("),
    },
    "lookup": {
        "rust": (".find(", ".position(", ".contains(", ".contains_key(", ".get(", ".binary_search("),
        "python": (" in ", ".index(", ".get(", ".count("),
        **dict.fromkeys(_SCRIPT, (".find(", ".findindex(", ".includes(", ".indexof(", ".get(", ".has(")),
        "go": ("strings.contains(", "slices.contains(", "maps.lookup", "map["),
        "cpp": (".find(", ".contains(", "std::find("),
        "swift": (".contains(", ".firstindex(", ".first(where:"),
    },
    "length": {
        "rust": (".len()", ".is_empty()"),
        "python": ("len(", ".__len__("),
        **dict.fromkeys(_SCRIPT, (".length", ".size")),
        "go": ("len(",),
        "cpp": (".size()", ".empty()"),
        "swift": (".count", ".isempty"),
    },
    "mutation": {
        "rust": ("push(", "insert(", "remove(", "clear(", "append(", "mut self", "&mut self"),
        "python": ("append(", "extend(", "update(", "pop(", "remove("),
        **dict.fromkeys(_SCRIPT, ("push(", "splice(", "set(", "delete ", ".assign(")),
        "go": ("append(", "delete("),
        "cpp": ("push_back(", "insert(", "erase(", "clear("),
        "swift": ("append(", "insert(", "remove(", "removeall("),
    },
    "locking": {
        "rust": ("mutex", "rwlock", ".lock()", ".read()", ".write()"),
        "python": ("threading.lock", "asyncio.lock", ".acquire("),
        **dict.fromkeys(_SCRIPT, ("atomics.", "mutex", "lock(")),
        "go": ("sync.mutex", "sync.rwmutex", ".lock()", ".rlock()"),
        "cpp": ("std::mutex", "std::lock_guard", ".lock()"),
        "swift": ("nslock", "dispatchqueue", ".lock()"),
    },
    "loop": {
        "rust": ("for ", "while ", "loop {"),
        "python": ("for ", "while "),
        **dict.fromkeys(_SCRIPT, ("for (", "while (", "for await", ".foreach(")),
        "go": ("for ",),
        "cpp": ("for (", "while ("),
        "swift": ("for ", "while "),
    },
    "exported_api": {
        "rust": ("pub fn ", "pub struct ", "pub enum ", "pub trait "),
        "python": ("__all__", "class ", "def "),
        **dict.fromkeys(_SCRIPT, ("export function", "export class", "export const", "module.exports")),
        "go": ("func ", "type "),
        "cpp": ("public:", "class ", "struct "),
        "swift": ("public func", "public struct", "public class"),
    },
    "collection_access": {"rust": ("[0]",), "python": ("[0]",), **dict.fromkeys(_SCRIPT, ("[0]", ".at(0)")), "go": ("[0]",), "cpp": ("[0]",)},
    "front_access": {"rust": (".first().unwrap()", ".last().unwrap()"), **dict.fromkeys(_SCRIPT, (".shift()",)), "cpp": (".front()", ".back()"), "swift": (".first!", ".last!")},
    "collection_guard": {
        "rust": (".len()", ".is_empty()"),
        "python": ("len(", "if not ", "if "),
        **dict.fromkeys(_SCRIPT, (".length", ".size", "!== 0", "> 0")),
        "go": ("len(",),
        "cpp": (".size()", ".empty()"),
        "swift": (".count", ".isempty"),
    },
    "async_locking": {
        "rust": (".lock().await", ".read().await", ".write().await", "tokio::sync::mutex", "tokio::sync::rwlock", "tokio::sync::semaphore", "futures::lock::mutex", "futures_util::lock::mutex", "async_std::sync::mutex", "async_lock::mutex"),
        "python": ("asyncio.lock", "async with"),
        **dict.fromkeys(_SCRIPT, ("await mutex", "await lock", "async-lock")),
    },
}
INDEX_NAMES = ("i", "j", "k", "n", "idx", "index", "pos", "ptr", "offset", "cursor")

#: Substring tests of systems code and their weights; any needle of a test counts once.
SYSTEMS_SIGNS = (
    (5, ("#![no_std]",)), (1, ("unsafe {", "unsafe fn")), (2, ("transmute",)), (2, ("repr(C)", "repr(packed)")), (1, ("Atomic",)), (1, ("*const", "*mut")), (1, ("Pin<Box",)),
)

#: Verbs -> the sentence around the rest of a name.
VERB_SENTENCES = (
    (("get", "fetch", "load", "read", "retrieve"), "Gets the ", "."),
    (("set", "write", "save", "store"), "Sets the ", "."),
    (("update", "sync", "refresh"), "Updates ", "."),
    (("is", "has", "can", "should", "will"), "Checks if ", "."),
    (("create", "new", "build", "make", "init"), "Creates ", "."),
    (("delete", "remove", "drop", "clear"), "Removes ", "."),
    (("parse", "extract", "decode"), "Parses ", "."),
    (("validate", "check", "verify"), "Validates ", "."),
    (("render", "format", "display", "print"), "Formats ", " for output."),
    (("handle", "process", "run", "exec"), "Processes ", "."),
    (("convert", "transform", "map"), "Converts ", "."),
    (("find", "search", "lookup", "query"), "Finds ", "."),
    (("test", "spec"), "Tests ", "."),
)
#: Of equally frequent verbs the one of the first group wins; others come last.
VERB_PRIORITY = (("parse", "extract", "decode"), ("validate", "check", "verify"), ("render", "format", "display", "print"), ("infer", "classify"), ("get", "find", "search", "lookup", "query"))
SHORT_THEMES = ("db", "ui", "io", "id", "os", "fs", "vm", "ip")

#: Operator -> mutant, kind.
MUTATIONS = {
    "==": ("!=", "CMP"), "!=": ("==", "CMP"), "<": (">=", "CMP"), ">": ("<=", "CMP"), "<=": (">", "CMP"), ">=": ("<", "CMP"),
    "&&": ("||", "LOG"), "||": ("&&", "LOG"), "and": ("or", "LOG"), "or": ("and", "LOG"),
    "true": ("false", "BOOL"), "false": ("true", "BOOL"), "True": ("False", "BOOL"), "False": ("True", "BOOL"),
    "+": ("-", "MATH"), "-": ("+", "MATH"), "*": ("/", "MATH"), "/": ("*", "MATH"),
}

#: badge, exports that must all be contained, parameter types and annotations of which any must be.
ROLES = (
    ("Manages", ("Install", "Uninstall"), (), ()), ("Fetches", ("Fetch",), (), ()), ("Handles HTTP requests for", (), ("http.ResponseWriter",), ()),
    ("Persists", (), (), ("gorm", "db", "serde")), ("Registers", ("Register",), (), ()),
)
DOMAINS = (("GitHub releases", r"api\.github\.com|/repos/"), ("macOS launch agents", r"Library/LaunchAgents"), ("Windows registry autostart", r"CurrentVersion\\Run"))
MECHANISMS = (("HTTP API", "net/http"), ("SQL", "database/sql"), ("Windows registry", "golang.org/x/sys/windows/registry"), ("subprocess execution", "os/exec"), ("JSON serialization", "encoding/json"), ("file I/O", "std::fs"))

CONFIDENCE_RANK = {"Info": 0, "Medium": 1, "High": 2}
DATA_DERIVES = ("Serialize", "Deserialize", "Parser", "Args")
#: Marker file -> project type, by priority.
PROJECT_MARKERS = (("Cargo.toml", "rust"), ("package.json", "node"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python"), ("go.mod", "go"))

#: Substrings of paths that rules on speed leave out.
PERF_EXEMPT = ("/cli/", "/ui/", "/tui/", "reporting", "messages", "analysis/", "audit/", "pack/", "signatures/")
PERF_EXEMPT_END = "main.rs"

#: Language -> parts of a path, of a text and of annotations that tell a test; sought in lower case.
TEST_SIGNS = {
    "rust": (("/tests/", "_test.rs", "tests/"), ("#[test]", "#[cfg(test)]"), ("test",)),
    "python": (("/tests/", "/test_", "_test.py"), ("def test_", "pytest", "unittest", "testcase"), ("pytest",)),
    **dict.fromkeys(_SCRIPT, ((".test.", ".spec.", "/__tests__/"), ("describe(", "it(", "test(", "expect("), ())),
    "go": (("_test.go", "/tests/"), ("func test", "testing.t", "t.run("), ()),
    "cpp": (("/tests/", "_test.", "_spec."), ("test(", "test_f(", "expect_", "assert_"), ()),
    "swift": (("tests/", "tests.swift"), ("xctestcase", "func test", "xctassert"), ()),
}
GLOBAL_CONTAINERS = ("Mutex<Vec", "Mutex<HashMap", "RwLock<Vec", "RwLock<HashMap")
#: File name -> build system; files of the ending cmake are CMake too.
BUILD_FILES = {
    "Cargo.toml": "Rust", "package.json": "Node", "requirements.txt": "Python", "pyproject.toml": "Python", "Pipfile": "Python", "go.mod": "Go",
    "CMakeLists.txt": "CMake", "conanfile.txt": "Conan", "conanfile.py": "Conan",
}

#: Words of comments that speak of an item, not of a module.
LICENSE_SIGNS = (
    "copyright", "spdx-license", "licensed under", "this file is part of", "permission is hereby granted", "redistribution and use", "this program is free software", "all rights reserved",
)
DOC_VERBS = (
    "add", "allow", "apply", "build", "calculate", "call", "check", "compile", "compute", "connect", "continue", "convert", "create", "decode", "delete", "determine", "disconnect", "emit",
    "encode", "ensure", "execute", "extract", "fetch", "fill", "find", "flush", "format", "generate", "get", "handle", "implement", "indicate", "initialize", "insert", "invoke", "load",
    "look", "map", "merge", "notify", "open", "parse", "perform", "process", "produce", "push", "put", "read", "receive", "register", "remove", "render", "represent", "request", "reset",
    "resolve", "return", "round", "run", "save", "scan", "send", "serialize", "set", "skip", "sort", "specify", "start", "stop", "store", "strip", "submit", "test", "toggle", "transform",
    "trigger", "update", "validate", "verify", "visit", "walk", "write", "yield",
)
STATE_PREFIXES = ("whether ", "if ", "when ", "true ", "false ", "set to ", "used to ", "used for ", "called when", "called by", "called after", "called before")
QUANTITY_PREFIXES = ("maximum ", "minimum ", "default ", "number of ", "count of ", "size of ", "the number", "the count", "the size")
INTERNAL_TERMS = ("field", "parameter", "argument", "return value", "struct member", "enum variant", "callback", "handler")
SCRIPT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "json", "d.ts")

#: Law -> why it matters and what to do, in this library's words.
GUIDANCE = {
    "P06": ("Each turn of the loop searches a whole collection.", "Build a set or map before the loop."),
    "L02": ("The bound admits the length itself, one past the last index.", "Compare with a strict bound."),
    "L03": ("An empty collection has no first or last element.", "Check for emptiness, or take an optional element and handle its absence."),
    "X01": ("Values formatted into SQL can change its meaning.", "Bind parameters."),
    "C03": ("A guard that lives across an await blocks other tasks.", "Drop the guard before waiting."),
    "C04": ("Nobody can tell what the lock protects.", "Say so in a comment above it."),
    "S01": ("Any code may change a mutable static at any time.", "Pass the state, or use an atomic."),
    "S02": ("A public static couples modules through shared state.", "Make it private, or a constant."),
    "S03": ("A global container grows for as long as the program runs.", "Hand the data to those who need it."),
    "M03": ("Callers expect a getter to leave its object as it is.", "Rename it, or take the object unchanged."),
    "M04": ("Callers expect a predicate to answer yes or no.", "Return a boolean, or rename it."),
    "M05": ("Callers expect a calculation to change nothing.", "Split the change from the calculation."),
    "I01": ("The conversion could be derived.", "Derive it where macros are in use already."),
    "LAW OF PARANOIA": ("A wrong assumption ends the program or breaks its memory.", "Handle the other case, or state why it can't occur."),
    "LAW OF ATOMICITY": ("A long file holds more than one concern.", "Split it."),
}

#: C++: names that start like these are handlers of a framework; words that look like calls but aren't functions.
CPP_HANDLERS = ("On", "PreCreate", "DoDataExchange", "AssertValid", "Dump", "WindowProc")
CPP_WORDS = ("if", "for", "while", "switch", "catch", "return", "delete", "new", "sizeof")

#: Names and values of the rule on secrets.
SECRET_NAME = r"(?i)(key|secret|token|password|auth)"
PLACEHOLDERS = r"(?i)(example|placeholder|test|dummy|xxx|your_)"

#: Messages that results hold, as patterns of printf.
LOCALITY_SUGGESTIONS = {
    "ENCAPSULATION_BREACH": "Expose needed API from '%s' instead of importing '%s'",
    "MISSING_HUB": "Promote '%s' to Hub (fan-in: %d). Add to [rules.locality].hubs",
    "UPWARD_DEP": "Layer violation. Move '%s' down to a lower layer or extract shared code.",
    "SIDEWAYS_DEP": "Route through Hub or move '%s' closer",
}
TYPE_MESSAGES = {
    "LCOM4": "Class '%s' has low cohesion (LCOM4: %d)",
    "AHF": "Class '%s' exposes too much state (AHF: %s%%)",
    "CBO": "Class '%s' is tightly coupled (CBO: %d)",
    "SFOUT": "Class '%s' has high fan-out (SFOUT: %d)",
}
#: Law, message and confidence of the rules on blocks.
BLOCK_LAWS = {
    "nesting": ("LAW OF COMPLEXITY", "Function '%s' has nesting depth %d (Max: %d)", "High"),
    "cognitive": ("LAW OF COMPLEXITY", "Function '%s' has cognitive complexity %d (Max: %d)", "High"),
    "loop_conversions": ("P02", "String conversion inside loop", "High"),
    "nested_loops": ("P04", "Nested loop (O(n²)) detected", "Medium"),
    "unflushed_writers": ("R07", "`BufWriter` without `flush()`", "High"),
    "duplicate_arms": ("I02", "Duplicate match arm bodies", "High"),
    "shell_commands": ("X02", "Shell Injection risk: dynamic value used as shell executable", "High"),
    "command_sources": ("X02", "Untrusted executable provenance: `%s` passed to Command::new", "Medium"),
}
#: Names of variables: of shells; of programs that are trusted, also behind an underscore; parts of names of functions that read a configuration.
SHELLS = ("sh", "bash", "dash", "zsh", "fish", "cmd", "powershell", "pwsh")
TRUSTED_COMMANDS = (
    "cmd", "command", "binary", "executable", "exe", "program", "prog", "shell", "interpreter", "compiler", "linker", "tool", "bin_path", "pbcopy", "pbpaste", "xclip", "xsel", "wl_copy", "wl_paste",
    "clip", "powershell", "osascript", "git", "cargo", "rustc", "tailwind", "npx", "node", "python", "python3",
)
CONFIG_FUNCTIONS = ("parse", "load", "read", "from_", "deserialize", "config", "manifest", "build", "setup")
#: What a function with a buffered writer may say to be left alone; languages that skeletons are made of.
FLUSH_SIGNS = (".flush()", "-> BufWriter", "-> impl Write", "Ok(BufWriter")
SKELETON_LANGUAGES = ("rust", "typescript", "javascript", "swift")
#: Kinds of definitions by the word that begins them; words that stand before a bracket without being called.
DEFINITION_KINDS = {
    "fn": "function", "function": "function", "func": "function", "def": "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module",
    "const": "constant", "static": "constant", "type": "type", "class": "class", "interface": "interface", "protocol": "interface",
}
CALL_LIKE_WORDS = ("if", "while", "for", "match", "return", "in", "fn", "move", "let", "else", "loop", "impl", "where", "as", "mut", "ref")
#: Strings that tell something however short they are; words of comments that tell nothing.
TELLING_STRINGS = r"https?://|^(?:HKEY_|HKLM|HKCU)|^~/|^/etc/|^[A-Za-z]:\\|^%APPDATA%|/api/|/v\d+/|/repos/|(?i:\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE TABLE)\b)|(?i:Bearer |Authorization:|client_secret)"
COMMENT_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")
