"""Names that a language or its standard library brings along: references to them lead out of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT = ("typescript", "javascript", "tsx", "jsx")
# Names that count as built in, by language.
SCRIPT_NAMES = (
    "console window document global process Promise Array Object String Number Boolean Date Math JSON RegExp Error Map Set "
    "setTimeout setInterval clearTimeout clearInterval fetch require module exports __dirname __filename"
).split()
SCRIPT_RECEIVERS = ("console.", "Math.", "JSON.")
HOOKS = "useState useEffect useContext useReducer useCallback useMemo useRef useLayoutEffect useImperativeHandle useDebugValue".split()
PYTHON_NAMES = "print len range str int float list dict set tuple open input type isinstance hasattr getattr setattr super self cls None True False".split()
PYTHON_TYPES = "list dict set tuple str int float bool bytes bytearray frozenset object super".split()
PYTHON_METHODS = (
    "append extend insert remove pop clear sort reverse copy update keys values items get add discard union intersection difference "
    "split join strip lstrip rstrip replace lower upper startswith endswith find index count encode decode format isdigit isalpha isalnum "
    "read write readline readlines close flush seek"
).split()
GO_PACKAGES = (
    "fmt os io net http log math sort sync time path bytes strings strconv errors context json xml csv html template regexp reflect "
    "runtime testing flag bufio crypto encoding filepath hash mime rand signal sql syscall unicode unsafe atomic binary debug exec heap "
    "ring scanner tar zip gzip zlib tls url user pprof trace ast build parser printer token types cgo plugin race ioutil utilruntime utilwait utilnet"
).split()
GO_NAMES = (
    "make new len cap append copy delete close panic recover print println complex real imag error nil true false iota "
    "int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string bool byte rune any"
).split()
PASCAL_PREFIXES = ("System.", "Winapi.", "Vcl.", "Fmx.", "Data.", "Datasnap.", "Soap.", "Xml.", "Web.", "REST.", "FireDAC.", "IBX.", "IdHTTP", "IdTCP", "IdSSL")
PASCAL_NAMES = (
    "System SysUtils Classes Types Variants StrUtils Math DateUtils IOUtils Generics.Collections Generics.Defaults Rtti TypInfo SyncObjs "
    "RegularExpressions SysInit Windows Messages Graphics Controls Forms Dialogs StdCtrls ExtCtrls ComCtrls Menus ActnList "
    "WriteLn Write ReadLn Read Inc Dec Ord Chr Length SetLength High Low Assigned FreeAndNil Format IntToStr StrToInt FloatToStr StrToFloat "
    "Trim UpperCase LowerCase Pos Copy Delete Insert Now Date Time DateToStr StrToDate Raise Exit Break Continue Abort "
    "True False nil Self Result Create Destroy Free TObject TComponent TPersistent TInterfacedObject TList TStringList TStrings TStream "
    "TMemoryStream TFileStream Exception EAbort EConvertError EAccessViolation IInterface IUnknown"
).split()
# Modules that are no part of a project, by how an import names them.
NODE_MODULES = (
    "fs path os crypto http https url util events stream child_process buffer net tls readline zlib querystring string_decoder assert "
    "v8 vm worker_threads cluster dns dgram process module console"
).split()
PYTHON_MODULES = (
    "os sys json re math datetime collections typing pathlib logging io abc copy functools itertools operator string struct time random "
    "hashlib urllib http email xml csv configparser argparse unittest dataclasses enum contextlib threading multiprocessing subprocess "
    "socket ssl select queue heapq bisect weakref gc inspect ast dis traceback warnings tempfile shutil glob fnmatch stat pickle shelve "
    "sqlite3 base64 binascii codecs locale gettext pprint textwrap difflib"
).split()
LOCAL_PREFIXES = (".", "@/", "~/", "src/", "app/")


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found |= c.startswith(p)
    return found


def is_external(name: Column, language: Column) -> Column:
    """Whether a reference's name alone tells that it leads out of the project."""
    head, method = F.substring_index(name, ".", 1), F.substring(name, F.instr(name, ".") + 1, F.length(name))
    dotted = F.instr(name, ".") > 1
    script = name.isin(*SCRIPT_NAMES, *HOOKS) | _starts(name, SCRIPT_RECEIVERS)
    python = name.isin(*PYTHON_NAMES, *PYTHON_METHODS) | dotted & head.isin(*PYTHON_TYPES)
    go = name.isin(*GO_NAMES) | dotted & head.isin(*GO_PACKAGES)
    pascal = name.isin(*PASCAL_NAMES) | _starts(name, PASCAL_PREFIXES)
    return language.isin(*SCRIPT) & script | (language == "python") & python | (language == "go") & go | (language == "pascal") & pascal


def internal(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs but for those that lead out of the project.  A Python call such as items.append goes too, unless a symbol is named like its receiver with a capital (Items)."""
    name = F.col("reference_name")
    left = refs.filter(~F.coalesce(is_external(name, F.col("language")), F.lit(False)))
    receiver = F.substring_index(name, ".", 1)
    method = F.substring(name, F.instr(name, ".") + 1, F.length(name))
    doubtful = (F.col("language") == "python") & (F.instr(name, ".") > 1) & method.isin(*PYTHON_METHODS)
    title = F.concat(F.upper(F.substring(receiver, 1, 1)), F.substring(receiver, F.lit(2), F.length(receiver)))
    known = nodes.select(F.col("name").alias("title")).distinct()
    kept = left.filter(doubtful).withColumn("title", title).join(known, "title", "left_semi").select(refs.columns)
    return left.filter(~F.coalesce(doubtful, F.lit(False))).unionByName(kept)


def is_external_module(module: Column, language: Column) -> Column:
    """Whether an import names a module of the language, of the platform or of another project."""
    root = F.substring_index(module, "/", 1)
    script = root.isin(*NODE_MODULES) | module.startswith("node:") | module.startswith("@") | ~module.contains("/")
    found = (
        F.when(language.isin(*SCRIPT), script)
        .when(language == "python", F.substring_index(module, ".", 1).isin(*PYTHON_MODULES))
        .when(language == "go", F.lit(True))
        .when(language == "java", _starts(module, ("java.", "javax.", "android.", "kotlin.")))
        .when(language == "csharp", _starts(module, ("System", "Microsoft", "global::")))
        .when(language.isin("ruby", "c", "cpp"), ~module.contains("/"))
        .otherwise(F.lit(False))
    )
    return ~_starts(module, LOCAL_PREFIXES) & found
