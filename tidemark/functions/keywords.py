"""Fixed word lists.

FIXED VALUES: these lists must equal the benchmark's lists word for word,
because scores and renames depend on them. They are stated plainly, in the
benchmark's natural order.
"""

from __future__ import annotations

import builtins

# --- fixed values: keyword weights for the weighted n-gram score (1.0 keyword, 0.2 otherwise)
KEYWORDS = {
    "python": (
        "False None True and as assert async await break class continue def del elif else "
        "except finally for from global if import in is lambda nonlocal not or pass raise "
        "return try while with yield"
    ).split(),
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do "
        "double else enum extends final finally float for goto if implements import instanceof "
        "int interface long native new package private protected public return short static "
        "strictfp super switch synchronized this throw throws transient try void volatile while"
    ).split(),
    "cpp": (
        "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t "
        "char32_t class compl concept const constexpr const_cast continue co_await co_return "
        "co_yield decltype default delete do double dynamic_cast else enum explicit export "
        "extern false float for friend goto if inline int long mutable namespace new noexcept "
        "not not_eq nullptr operator or or_eq private protected public register "
        "reinterpret_cast requires return short signed sizeof static static_assert static_cast "
        "struct switch template this thread_local throw true try typedef typeid typename union "
        "unsigned using virtual void volatile wchar_t while xor xor_eq"
    ).split(),
    "c_sharp": (
        "abstract as base bool break byte case catch char checked class const continue decimal "
        "default delegate do double else enum event explicit extern false finally fixed float for "
        "foreach goto if implicit in int interface internal is lock long namespace new null "
        "object operator out override params private protected public readonly ref return sbyte "
        "sealed short sizeof stackalloc static string struct switch this throw true try typeof "
        "uint ulong unchecked unsafe ushort using virtual void volatile while add alias ascending "
        "async await by descending dynamic equals from get global group into join let nameof "
        "notnull on orderby partial remove select set unmanaged value var when where yield"
    ).split(),
}

# --- fixed values: names the renamer never touches, per language
RENAME_EXCLUDE_CPP = (
    "alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t "
    "char32_t class compl const constexpr const_cast continue decltype default delete do double "
    "dynamic_cast else enum explicit export extern false float for friend goto if inline int "
    "long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected "
    "public register reinterpret_cast return short signed sizeof static static_assert "
    "static_cast struct switch template this thread_local throw true try typedef typeid typename "
    "union unsigned using virtual void volatile wchar_t while xor xor_eq main"
).split()

RENAME_EXCLUDE_JAVA = KEYWORDS["java"]

# Python: keywords, common builtins, common methods/arguments, common stdlib modules
# (fixed values), plus every name of the running interpreter's builtins module (rule).
RENAME_EXCLUDE_PY_FIXED = (
    "False None True and as assert async await break class continue def del elif else except "
    "finally for from global if import in is lambda nonlocal not or pass raise return try while "
    "with yield "
    "abs divmod input open staticmethod all enumerate int ord str any eval isinstance pow sum "
    "basestring execfile issubclass print super bin file iter property tuple bool filter len "
    "range type bytearray float list raw_input unichr callable format locals reduce unicode chr "
    "frozenset long reload vars classmethod getattr map repr xrange cmp globals max reversed zip "
    "compile hasattr memoryview round __import__ complex hash min set delattr help next setattr "
    "dict hex object slice dir id oct sorted "
    "append end sort reverse insert remove pop clear extend index count copy join sep split "
    "strip find replace read write close "
    "os sys math random datetime json re collections functools itertools heapq bisect copy "
    "pickle csv configparser logging argparse subprocess threading multiprocessing socket "
    "asyncio queue select ssl http xml urllib ftplib poplib smtplib sqlite3 zlib gzip time "
    "calendar hashlib base64 binascii struct codecs unicodedata io"
).split()


def rename_exclude_py() -> list[str]:
    names = list(dict.fromkeys(RENAME_EXCLUDE_PY_FIXED + sorted(dir(builtins))))
    return names


# --- fixed values: language names and codes
LANG_CODE = {"C++": "cpp", "Java": "java", "Python": "python", "C#": "c_sharp"}
