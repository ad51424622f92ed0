"""Checks of Python source as vectorised helpers: guards, operation lists, canonical forms, functions of a file."""

from __future__ import annotations

import ast
import difflib
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from proofmill.vocab import COUNTED_OPS, FORMS, FREE_OPS

# What generated code must not call.
BANNED_PREFIXES = ("torch.rand", "torch.empty", "torch.zeros", "torch.ones")
BANNED_CALLS = frozenset({"torch.full", "torch.tensor", "torch.arange"})
BANNED_METHODS = frozenset(["to", "cuda", "cpu", "type", "type_as", "float", "half", "double", "bfloat16"])
SPEC_BANNED_PREFIXES = (*BANNED_PREFIXES, "torch.full", "torch.tensor", "torch.cuda", "torch.cpu")
SPEC_BANNED_METHODS = frozenset(["to", "cuda", "cpu", "type", "type_as", "fill_", "zero_", "uniform_", "normal_", "random_"])
FORMS_OF_EXPRESSION = (ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp, ast.Lambda)
#: Codes of syntax that straight-line code has no place for.
UNFIT = dict.fromkeys((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef), "definition") | dict.fromkeys((ast.If, ast.For, ast.While, ast.Try, ast.With, ast.Match), "flow") | dict.fromkeys(FORMS_OF_EXPRESSION, "expression")


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a plain chain of attributes, else None."""
    names = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return ".".join([node.id, *names]) if isinstance(node, ast.Name) else None


def _preorder(node: ast.AST):
    """Nodes of a tree, parents first, children in order; what a node stops at is told by sending True."""
    stop = yield node
    if not stop:
        for child in ast.iter_child_nodes(node):
            yield from _preorder(child)


def _fault(node: ast.AST) -> str | None:
    """The code of what the train guard holds against a single node."""
    if type(node) in UNFIT:
        return UNFIT[type(node)]
    if isinstance(node, ast.Return) and (node.value is None or isinstance(node.value, ast.Tuple)):
        return "result"
    if isinstance(node, ast.Call):
        path = dotted(node.func) or ""
        if path in BANNED_CALLS or path.startswith(BANNED_PREFIXES):
            return f"call:{path}"
        if getattr(node.func, "attr", None) in BANNED_METHODS:
            return f"method:{node.func.attr}"
    return None


def _faults(body: list[ast.stmt]):
    """Codes of all that keeps a module from being ``import torch`` and one straight-line function, the most basic ones first."""
    if not body or not isinstance(body[0], ast.Import) or [(x.name, x.asname) for x in body[0].names] != [("torch", None)]:
        yield "import"
    if [type(x) for x in body[1:]] != [ast.FunctionDef]:
        yield "module"
        return
    fn = body[1]
    given = fn.args
    for code, wrong in (("decorator", fn.decorator_list), ("no_argument", not (given.args or given.posonlyargs)), ("argument_kind", given.vararg or given.kwarg or given.kwonlyargs)):
        if wrong:
            yield code
    for statement in fn.body:
        for node in _preorder(statement):
            if code := _fault(node):
                yield f"{code}@{node.lineno}"
    if [x for x in ast.walk(fn) if isinstance(x, ast.Return)] != [fn.body[-1]]:
        yield "return"


def train_reason(code: str) -> str | None:
    """A code of why text is no straight-line function over ``import torch``, with the line where there is one, or None."""
    try:
        return next(_faults(ast.parse(code).body), None)
    except (SyntaxError, ValueError) as e:
        return f"syntax@{getattr(e, 'lineno', None) or 0}"


#: Of these only what an evaluation spec has no place for; other statements are looked into.
SPEC_UNFIT = {k: v for k, v in UNFIT.items() if k in (ast.FunctionDef, ast.If, ast.For, ast.While, *FORMS_OF_EXPRESSION)}


def _called(node: ast.Call) -> tuple[str, str] | None:
    """What a call counts as: a counted operation, a fault, or nothing."""
    path = dotted(node.func)
    if path is None:
        return "callee", type(node.func).__name__
    own, method = path.startswith("torch."), path.rpartition(".")[2]
    if path in COUNTED_OPS:
        return "op", path
    if path in FREE_OPS or (not own and method in FREE_OPS):
        return None
    if own:
        return ("call" if path.startswith(SPEC_BANNED_PREFIXES) else "unlisted"), path
    return ("method" if method in SPEC_BANNED_METHODS else "unlisted"), method


def _form(node: ast.AST) -> tuple[str, str] | None:
    """The fault of a node that is no call: an operator on values, or syntax without a place."""
    if type(node) in SPEC_UNFIT:
        return SPEC_UNFIT[type(node)], type(node).__name__
    if isinstance(node, ast.BinOp):
        return "operator", type(node.op).__name__
    if isinstance(node, ast.UnaryOp) and not isinstance(node.op, ast.Not):
        number = isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, (int, float))
        return None if number and not isinstance(node.op, ast.Invert) else ("sign", type(node.op).__name__)
    return None


def _events(body: list[ast.stmt]):
    """``(kind, detail, line)`` of a body in order of evaluation: ``op`` for counted operations, other kinds are faults.

    A stack holds what is still to do; a call comes back once its arguments are done. What is inside
    a fault is not looked at; signs count only until the first fault.
    """
    todo, clean = [(n, False) for n in reversed(body)], True
    while todo:
        node, ready = todo.pop()
        if isinstance(node, ast.Call) and not ready:
            todo.append((node, True))
            todo += [(n, False) for n in reversed([*node.args, *(k.value for k in node.keywords)])]
            continue
        event = _called(node) if ready else _form(node)
        if event and (clean or event[0] != "sign"):
            clean &= event[0] == "op"
            yield *event, node.lineno
        elif not ready:
            todo += [(n, False) for n in reversed(list(ast.iter_child_nodes(node)))]


def operations(code: str) -> list[str] | None:
    """Counted operations of the first function in order of evaluation; None if the code can't be parsed."""
    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError):
        return None
    functions = [n.body for n in body if isinstance(n, ast.FunctionDef)]
    return [path for kind, path, _ in _events(functions[0] if functions else []) if kind == "op"]


def _spec_faults(body: list[ast.stmt], form: str, ops: list[str], n_inputs: int):
    """Codes of all that keeps a module from being the function that a spec asks for: module, signature, body, operations."""
    functions, imports = [n for n in body if isinstance(n, ast.FunctionDef)], [n for n in body if isinstance(n, ast.Import)]
    for node in body:
        names = [x.name if x.asname is None else f"{x.name}={x.asname}" for x in node.names] if node in imports else []
        for name in names:
            if name != "torch":
                yield f"import:{name}@{node.lineno}"
        if not names and node is not next(iter(functions), None):
            yield f"module:{type(node).__name__}@{node.lineno}"
    if not imports:
        yield "no_import"
    if not functions:
        yield "no_function"
        return
    given = functions[0].args
    plain = len(given.args)
    if [len(x) for x in (given.posonlyargs, given.kwonlyargs, given.defaults, given.kw_defaults)] != [0] * 4 or given.vararg or given.kwarg:
        yield f"signature@{functions[0].lineno}"
    if plain != n_inputs:
        yield f"inputs:{plain}/{n_inputs}@{functions[0].lineno}"
    found = list(_events(functions[0].body))
    yield from (f"{kind}:{detail}@{line}" for kind, detail, line in found if kind != "op")
    used, asked = [path for kind, path, _ in found if kind == "op"], len(FORMS[form][2])
    if len(used) != asked:
        yield f"count:{len(used)}/{asked}"
    if used != list(ops):
        yield "order:" + ",".join(used)


def spec_reason(code: str, form: str, ops: list[str], n_inputs: int) -> str | None:
    """A code of the first thing that text has against an evaluation spec, with the line where there is one, or None."""
    try:
        return next(_spec_faults(ast.parse(code).body, form, ops, n_inputs), None)
    except (SyntaxError, ValueError) as e:
        return f"syntax@{getattr(e, 'lineno', None) or 0}"


class _Names(ast.NodeTransformer):
    """Local names in order of appearance as v0, v1, ..."""

    def __init__(self, local: set[str]):
        self.local, self.names = local, {}

    def name(self, old: str) -> str:
        return self.names.setdefault(old, f"v{len(self.names)}") if old in self.local else old

    def visit_arg(self, node: ast.arg) -> ast.arg:
        return ast.copy_location(ast.arg(arg=self.name(node.arg)), node)

    def visit_Name(self, node: ast.Name) -> ast.Name:
        return ast.copy_location(ast.Name(id=self.name(node.id), ctx=node.ctx), node)


def canonical_hash(code: str) -> str:
    """Digest that identifier-only changes keep; text that can't be parsed has the digest of its own bytes."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return hashlib.sha256(code.encode("utf-8", "surrogatepass")).hexdigest()
    for i, node in enumerate(tree.body):
        if isinstance(node, ast.FunctionDef):
            local = {n.arg for n in ast.walk(node) if isinstance(n, ast.arg)} | {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
            node.name = "candidate"
            tree.body[i] = _Names(local).visit(node)
    return hashlib.sha256(ast.unparse(tree).encode()).hexdigest()


def jit_functions(source: str) -> list[tuple[str, str]]:
    """(name, source) of every function decorated with ``triton.jit``, bare or called; none if the file can't be parsed."""
    if "triton" not in source:
        return []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    marks = lambda f: any(dotted(d.func if isinstance(d, ast.Call) else d) == "triton.jit" for d in f.decorator_list)
    return [(n.name, ast.get_source_segment(source, n) or "") for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and marks(n)]


def unified_diff(before: str | None, after: str | None) -> str | None:
    """Unified diff; null without an earlier text, empty for equal texts."""
    if before is None or after is None:
        return None
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), "previous", "current"))


def _each(f, kind):
    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else f(t))

    return run


#: Column forms: a null text gives null.
guard_train = _each(train_reason, StringType())
canonical = _each(canonical_hash, StringType())
ops_of = _each(operations, ArrayType(StringType()))


@F.pandas_udf(StringType())
def guard_spec(code: pd.Series, form: pd.Series, ops: pd.Series, n_inputs: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else spec_reason(c, f, list(o), int(n)) for c, f, o, n in zip(code, form, ops, n_inputs, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def diff_of(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([unified_diff(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def extract_functions(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """C9 over files: ``path``, ``function_name``, ``source``, a row for each decorated function."""

    def run(frames):
        for frame in frames:
            rows = [(p, name, source) for p, t in zip(frame[path], frame[text], strict=True) for name, source in jit_functions(t or "")]
            yield pd.DataFrame(rows, columns=[path, "function_name", "source"])

    return files.where(F.col(text).contains("triton")).select(path, text).mapInPandas(run, f"{path} string, function_name string, source string")
