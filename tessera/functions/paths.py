"""What a path and the head of a file say: sensitive, generated, test, language, kind of degradation.  All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names and extensions never read, by class.
SENSITIVE = (
    ("env_file", r"^(?:\.env|\.envrc|\.env\..*|.*\.env)$"),
    ("private_key", r"^(?:id_(?:rsa|ed25519|ecdsa|dsa).*|.*\.(?:pem|key|ppk))$"),
    ("keystore", r"^.*\.(?:p12|pfx|jks|keystore|kdbx)$"),
    ("credentials", r"^(?:credentials|credentials\.json|\.git-credentials|\.htpasswd|secrets\.(?:json|yml|yaml|toml)|service-account.*\.json)$"),
    ("registry_auth", r"^(?:\.npmrc|\.yarnrc\.yml|\.pypirc|\.netrc|_netrc)$"),
    ("infra_state", r"^(?:.*\.tfstate|.*\.tfstate\..*|.*\.tfvars|.*\.tfvars\.json|kubeconfig)$"),
    ("mobile_config", r"^(?:google-services\.json|googleservice-info\.plist)$"),
    ("vpn", r"^.*\.ovpn$"),
)
# Generated files by name, by suffix and by a banner in the head.
LOCKFILES = ("cargo.lock", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "deno.lock", "poetry.lock", "pipfile.lock", "uv.lock", "composer.lock", "gemfile.lock", "go.sum", "podfile.lock",
             "pubspec.lock", "package.resolved", "packages.lock.json", "flake.lock", "mix.lock", "gradle.lockfile")
GENERATED_SUFFIXES = (".min.js", ".min.mjs", ".min.css", ".js.map", ".css.map", ".pb.go", ".pb.gw.go", "_pb2.py", "_pb2.pyi", "_pb2_grpc.py", ".pb.cc", ".pb.h", "_pb.js", "_pb.d.ts", "_grpc_pb.js", ".pb.swift", ".grpc.swift",
                      ".g.dart", ".freezed.dart", ".designer.cs", ".g.cs", ".generated.cs")
BANNERS = ("@generated", "DO NOT EDIT", "<auto-generated")
BANNERS_ANY_CASE = ("code generated by", "this file was generated", "this file is generated", "this file was automatically generated", "this file is automatically generated", "this file has been generated", "automatically generated by",
                    "auto-generated by", "autogenerated by", "generated by the protocol buffer compiler", "generated by protoc", "protoc-gen-", "openapi generator", "openapi-generator", "swagger-codegen", "this code was generated by a tool")
# Language -> extensions.
EXTENSIONS = {
    "rust": "rs", "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js mjs cjs", "jsx": "jsx", "python": "py pyi pyw", "go": "go", "java": "java", "kotlin": "kt kts", "csharp": "cs csx", "dart": "dart", "swift": "swift",
    "php": "php", "ruby": "rb rake gemspec ru", "c": "c h", "cpp": "cc cpp cxx c++ hpp hh hxx h++ ipp tpp inl", "scala": "scala sc", "bash": "sh bash zsh ksh", "css": "css", "sql": "sql psql pgsql ddl", "protobuf": "proto",
    "markdown": "md markdown mdx mkd", "yaml": "yaml yml", "json": "json jsonc geojson webmanifest", "toml": "toml", "dockerfile": "dockerfile containerfile", "html": "html htm xhtml", "vue": "vue", "svelte": "svelte",
    "xml": "xml xsd xsl xslt plist csproj fsproj vbproj props targets", "graphql": "graphql gql graphqls", "hcl": "tf tfvars hcl", "lua": "lua", "perl": "pl pm", "r": "r", "elixir": "ex exs", "erlang": "erl hrl", "haskell": "hs lhs",
    "ocaml": "ml mli", "clojure": "clj cljs cljc edn", "zig": "zig", "objective_c": "m mm", "powershell": "ps1 psm1 psd1", "batch": "bat cmd", "ini": "ini cfg conf properties", "makefile": "mk mak", "cmake": "cmake",
    "groovy": "groovy gradle", "text": "txt text rst adoc asciidoc",
}
# Language -> whole file names.
FILE_NAMES = {
    "dockerfile": "dockerfile containerfile", "makefile": "makefile gnumakefile", "cmake": "cmakelists.txt", "groovy": "jenkinsfile", "toml": "pipfile cargo.lock poetry.lock uv.lock",
    "ruby": "gemfile rakefile podfile vagrantfile fastfile appfile brewfile guardfile capfile dangerfile berksfile thorfile", "bash": ".bashrc .bash_profile .bash_aliases .zshrc .zprofile .profile .envrc",
}
# Language -> interpreters of a first line.
INTERPRETERS = {
    "python": "python pypy", "javascript": "node nodejs bun", "typescript": "deno ts-node tsx", "bash": "bash sh zsh ksh dash ash", "ruby": "ruby", "php": "php", "perl": "perl", "powershell": "pwsh powershell", "lua": "lua luajit",
    "r": "Rscript", "swift": "swift", "scala": "scala", "groovy": "groovy", "elixir": "elixir", "erlang": "escript", "haskell": "runhaskell runghc", "kotlin": "kotlin kscript",
}
# Marks of C++ in a header.
CPP_MARKS = ("class ", "namespace ", "template<", "template <", "public:", "private:", "protected:", "std::", "constexpr ", "using ")
HEAD, HEAD_LINES = 8192, 40


def file_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def parent_name(path: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(path, "/?[^/]*$", ""), "/", -1))


def sensitive(path: Column) -> Column:
    """The class of a file whose content must not be read; null where it may be."""
    name = F.regexp_replace(F.substring_index(file_name(path), ":", 1), "[. ]+$", "")
    out = F.when(path.rlike(r"(?:^|/)\.(?:ssh|gnupg)/"), "private_key")
    for kind, pattern in SENSITIVE:
        out = out.when(name.rlike(pattern), kind)
        if kind == "registry_auth":
            out = out.when((name == "config.json") & (parent_name(path) == ".docker"), kind)
        if kind == "infra_state":
            out = out.when((name == "config") & (parent_name(path) == ".kube"), kind)
    return out


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def generated(path: Column, text: Column) -> Column:
    name = file_name(path)
    head = F.substring_index(F.substring(F.coalesce(text, F.lit("")), 1, HEAD), "\n", HEAD_LINES)
    low = F.lower(head)
    return name.isin(list(LOCKFILES)) | _any([name.endswith(s) for s in GENERATED_SUFFIXES]) | _any([head.contains(m) for m in BANNERS]) | _any([low.contains(m) for m in BANNERS_ANY_CASE])


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return F.substring_index(low, "/", -1).rlike("test|spec") | low.rlike(r"(?:^|/)(?:tests?|__tests__|specs?)/")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for language, keys in table.items() for k in keys.split() for x in (k, language)])


def language(path: Column, text: Column) -> Column:
    """By name, then extension, then first line; ``.h`` by its head; ``text`` where nothing tells."""
    name = file_name(path)
    by_name = F.when(name.rlike(r"^(?:docker|container)file\."), "dockerfile").otherwise(_lookup(FILE_NAMES)[name])
    extension = F.when(F.instr(F.substring(name, 2, 1 << 20), ".") > 0, F.substring_index(name, ".", -1))
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"^#!([^\r\n]*)", 1)
    words = F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != ""), lambda w: F.substring_index(w, "/", -1))
    rest = F.filter(F.slice(words, 2, 64), lambda w: ~w.startswith("-") & ~w.contains("="))
    program = F.regexp_replace(F.when(F.try_element_at(words, F.lit(1)) == "env", F.try_element_at(rest, F.lit(1))).otherwise(F.try_element_at(words, F.lit(1))), "[0-9.]+$", "")
    head = F.substring(F.coalesce(text, F.lit("")), 1, 65536)
    header = F.when(head.rlike("@interface|#import |@protocol"), "objective_c").when(_any([head.contains(m) for m in CPP_MARKS]), "cpp").otherwise("c")
    return F.coalesce(by_name, F.when(extension == "h", header), _lookup(EXTENSIONS)[extension], _lookup(INTERPRETERS)[program], F.lit("text"))


def skip_reason(path: Column, length: Column, head: Column, *, max_bytes: int = 1 << 20, excluded: Column | None = None) -> Column:
    """Why a walk leaves a file out: excluded, sensitive, too_large, binary or not_utf8; null where it is taken.  head: its first bytes."""
    out = F.when(path.rlike(r"(?:^|/)\.git/"), "excluded")
    out = out if excluded is None else out.when(excluded, "excluded")
    out = out.when(sensitive(path).isNotNull(), "sensitive").when(length > max_bytes, "too_large")
    return out.when(F.instr(F.hex(head), "00") % 2 == 1, "binary").when(~F.is_valid_utf8(head.cast("string")), "not_utf8")
