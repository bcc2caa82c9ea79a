"""Values that decide results and must stay as they are.

File rules, the extensions of popular languages, and the few other languages
needed to name a file's language without a full catalog.
"""

from __future__ import annotations

# Numbers standing for the role of a file and of a changed line.
GIT_INTERNAL = -1
SRC, TEST, DOC, CFG_BUILD_OTHER = 0, 1, 2, 3
CODE, COMMENT = 0, 1

# Parts of a path, extensions and root names that decide a file's role.
MEDIA_PATHS = ["/media/", "/pic/", "/img/"]
DOC_PATHS = ["/doc", "doc/", "docs/", "/log", "document", "manual", "usage", "changelog"]
DOC_EXTENSIONS = [".csv", ".doc", ".jpg", ".md", ".pdf", ".png", ".rdoc", ".svg", ".tex", ".txt"]
DOC_NAMES = ["USAGE", "README", "COPYING", "CONTRIBUTING", "INSTALL", "LICENSE", "MANIFEST", "THANKS"]
TEST_PATHS = [
    "unittest", "unit_test", "unit-test", "/t/", "/test", "_test", "-test", "test/", "tests/", "test_",
    "testing_", "tests_", "tests-", "testing-", "/spec/", "/specs/", "_spec", "-spec", "spec_", "specs_",
    "spec-", "specs-", "/grunt", "/ci/",
]
SOURCE_PATHS = ["/src/"]

# Popular programming languages and their file extensions.
POPULAR_EXTENSIONS = {
    "ActionScript": [".as"],
    "C": [".c", ".cats", ".h", ".idc", ".w"],
    "C#": [".cs", ".cake", ".cshtml", ".csx"],
    "C++": [
        ".cpp", ".c++", ".cc", ".cp", ".cxx", ".h", ".h++", ".hh", ".hpp", ".hxx", ".inc", ".inl", ".ipp",
        ".re", ".tcc", ".tpp",
    ],
    "Clojure": [".clj", ".boot", ".cl2", ".cljc", ".cljs", ".cljs.hl", ".cljscm", ".cljx", ".hic"],
    "CoffeeScript": [".coffee", "._coffee", ".cake", ".cjsx", ".iced"],
    "Go": [".go"],
    "Haskell": [".hs", ".hsc"],
    "Java": [".java"],
    "JavaScript": [
        ".js", "._js", ".bones", ".es", ".es6", ".frag", ".gs", ".jake", ".jsb", ".jscad", ".jsfl", ".jsm",
        ".jss", ".njs", ".pac", ".sjs", ".ssjs", ".xsjs", ".xsjslib",
    ],
    "Lua": [".lua", ".fcgi", ".nse", ".pd_lua", ".rbxs", ".wlua"],
    "Matlab": [".matlab", ".m"],
    "Objective-C": [".m", ".h"],
    "PHP": [".php", ".aw", ".ctp", ".fcgi", ".inc", ".php3", ".php4", ".php5", ".phps", ".phpt"],
    "Perl": [".pl", ".al", ".cgi", ".fcgi", ".perl", ".ph", ".plx", ".pm", ".pod", ".psgi", ".t"],
    "Python": [
        ".py", ".bzl", ".cgi", ".fcgi", ".gyp", ".gypi", ".lmi", ".py3", ".pyde", ".pyp", ".pyt", ".pyw",
        ".rpy", ".spec", ".tac", ".wsgi", ".xpy",
    ],
    "R": [".r", ".rd", ".rsx"],
    "Ruby": [
        ".rb", ".builder", ".eye", ".fcgi", ".gemspec", ".god", ".irbrc", ".jbuilder", ".mspec",
        ".pluginspec", ".podspec", ".rabl", ".rake", ".rbuild", ".rbw", ".rbx", ".ru", ".ruby", ".spec",
        ".thor", ".watchr",
    ],
    "Scala": [".scala", ".sbt", ".sc"],
    "Shell": [
        ".sh", ".bash", ".bats", ".cgi", ".command", ".fcgi", ".ksh", ".sh.in", ".tmux", ".tool", ".zsh",
    ],
    "Swift": [".swift"],
    "Vim script": [".vim"],
}

# Languages outside the popular set that share an extension with
# it and come first by name, and the most common other formats.
OTHER_EXTENSIONS = {
    "Assembly": [".inc"],
    "Batchfile": [".bat"],
    "CMake": [".cmake"],
    "CSS": [".css"],
    "CSV": [".csv"],
    "Dart": [".dart"],
    "Erlang": [".erl", ".es"],
    "GCC Machine Description": [".md"],
    "GLSL": [".frag"],
    "Genie": [".gs"],
    "Gradle": [".gradle"],
    "Groovy": [".groovy"],
    "HTML": [".html", ".htm"],
    "Hack": [".hh", ".php"],
    "INI": [".cfg", ".ini", ".properties"],
    "JSON": [".json"],
    "JSX": [".jsx"],
    "Julia": [".jl"],
    "Kotlin": [".kt"],
    "Less": [".less"],
    "Limbo": [".m"],
    "Objective-C++": [".mm"],
    "PLSQL": [".sql"],
    "Protocol Buffer": [".proto"],
    "RenderScript": [".rs"],
    "SCSS": [".scss"],
    "SVG": [".svg"],
    "Sass": [".sass"],
    "TOML": [".toml"],
    "TeX": [".tex"],
    "Text": [".txt"],
    "TypeScript": [".ts", ".tsx"],
    "XML": [".xml"],
    "YAML": [".yml", ".yaml"],
    "reStructuredText": [".rst"],
}

# Common files that have no extension, or one of their own.
FILE_NAMES = {
    "Dockerfile": ["Dockerfile"],
    "Makefile": ["Makefile"],
    "Ruby": ["Gemfile"],
    "Vim script": [".vimrc"],
}
