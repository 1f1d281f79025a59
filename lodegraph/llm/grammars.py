"""Lexers and grammars of the languages whose files are checked for valid syntax.

A grammar has token classes, pairs of classes that may stand side by side, and productions of
top-level statements. Patterns are those of java.util.regex. None of them loops over a group
with inner alternatives on the text itself, so that no text is too long for the lexer; in
productions such loops are possessive, which java matches without recursion, so that no statement is too long.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

#: What a backslash and the character after it become before lexing.
ESCAPED = "\u0001\u0001"
_MARKERS = r"(?m:^(?:<{7}|>{7}|\|{7})(?:[ \t][^\n]*)?$|^={7}\r?$)"
_IDENT = r"[\p{L}_][\p{L}\p{M}\p{N}_]*+"
_NUMBER = r"(?:\d\w*+\.\d\w*+|\.\d\w*+|\d\w*+\.(?![\w.])|\d\w*+)(?:(?<=[eEpP])[+-]\w++)?"
_BLOCK = r"/\*[\s\S]*?\*/"
_LINE = r"//[^\n]*+"
_NEWLINE = r"\n[ \t]*+"

# Token classes: I name, V value word, N number, S text, T template, L label or lifetime, Q word
# that is a keyword in places, H keyword that begins a statement, O else, R return, E other keyword that may end a statement,
# K other keyword, D directive, B operator with operands on both sides, P other operator, X what no valid file has, EOL, EOF;
# brackets , ; : . stand for themselves.
_CLASSES = ["I", "V", "N", "S", "T", "L", "Q", "K", "H", "O", "R", "E", "D", "B", "P", "(", ")", "[", "]", "{", "}", ",", ";", ":", ".", "EOL", "EOF"]
_STARTS = ["I", "V", "N", "S", "T"]
_ENDS = [*_STARTS, ")", "]"]


@dataclass(frozen=True)
class Grammar:
    name: str
    comment: str
    string: str
    name_pattern: str
    operators: str
    number: str
    #: Keywords by class.
    values: str = ""
    words: str = ""
    heads: str = ""
    #: Classes after which, without a line end or terminator, no new statement begins.
    unfinished: str = ""
    ending: str = ""
    #: The words of the classes O and R.
    alternative: str = ""
    returns: str = ""
    soft: str = ""
    binary: str = ""
    other: str = ""
    #: Pairs beyond the general rule that are allowed or not, as "class class".
    allowed: tuple[str, ...] = ()
    barred: tuple[str, ...] = ()
    #: Classes that may stand before and after an O, where the grammar rules out all others.
    before_alternative: str = ""
    after_alternative: str = ""
    #: Whether names after a "." may be keywords; how many ";" the brackets after "for" hold, none for any, and whether others may hold one.
    members: bool = False
    loop_parts: tuple[int, ...] = ()
    parts_elsewhere: bool = True
    #: Runs of three classes that are not allowed, as "class class class".
    triples: tuple[str, ...] = ()
    #: Whether four names in a row are none, of which soft words are no part.
    few_names: bool = False
    #: Pattern of a number token; of directives, with the form that a valid one has.
    number_token: str = _NUMBER
    directive: str = ""
    valid_directive: str = ""
    lines: bool = False
    #: Operators before and after which a line end doesn't end a statement.
    carries: str = ""
    #: Words and brackets kept as they are in statements; statements by their first word, then all others.
    productions: dict[str, str] = field(default_factory=dict)
    default: str = ""
    first: str = ""
    #: Symbols after a block that continue its statement.
    block_goes_on: str = ""
    #: Symbols before a block whose end closes the statement; empty for any.
    block_after: tuple[str, ...] = ()

    @property
    def lexer(self) -> str:
        start = "" if self.name == "python" else r"/\*"
        parts = [_MARKERS, self.comment, start, self.directive, self.string, self.number_token, self.name_pattern, _NEWLINE if self.lines else "", self.operators, r"[^\s\p{Cf}]"]
        return "|".join(p for p in parts if p)

    def pairs(self) -> set[tuple[str, str]]:
        """The permissible pairs: all pairs of classes but those that the grammar rules out."""
        out = set(product(_CLASSES, _CLASSES))
        out -= set(product(_ENDS, _STARTS))  # two operands need something between them
        closing = [")", "]", "}", ",", ";", "B", ".", "EOF"]
        out -= set(product(["B", "."], closing)) | set(product(["(", "[", "{", ","], ["B"]))
        out -= {(".", "N"), (".", "S"), (".", "T"), (".", ":"), (",", ","), (",", ";"), ("(", ","), ("[", ","), ("N", "("), ("N", "{") if self.name == "python" else ("N", "T")}
        out -= {(x, "EOF") for x in ("B", "P", ".", ",", "K", "H", "O", "(", "[", "{", ":", "L")}
        out -= set(product(self.unfinished.split(), ["H", "R", "E"])) | {(x, "O") for x in self.unfinished.split() if x != "}"}
        out -= {(x, "O") for x in _CLASSES if self.before_alternative and x not in self.before_alternative.split()}
        out -= {("O", x) for x in _CLASSES if self.after_alternative and x not in self.after_alternative.split()}
        if self.returns:
            out -= set(product(["R"], ["R", "H", "O"])) | set(product(["E"], ["R", "H", "O"]))
        split = lambda texts: {tuple(t.split(" ")) for t in texts}
        return (out | split(self.allowed)) - split(self.barred)


_C_OPS = r"<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]="
_ASSIGN = "= == != <= >= += -= *= /= %= &= |= ^= <<= >>="

#: What a target of a Python assignment can't have: an operator between operands, a call or a literal at its end.
NO_TARGET = r"(?<=[INST)\]}] )(?:\*\*?|//?|[-+%@&|^<>]|<<|>>|==|!=|<=|>=|and|or|in|is|not|if|else)(?= )|(?:I|\(\)|\[\]) \(\)(?= =|$)|(?:^|(?<= = ))[NS](?= =|$)"

PYTHON = Grammar(
    name="python",
    comment=r"#[^\n]*+",
    string=r"(?i:(?<![\w])(?:[rbuft]|br|rb|fr|rf|tr|rt))?(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*+\"|'[^'\n]*+')",
    name_pattern=_IDENT,
    operators=r"\*\*=|\*\*|//=|//|->|:=|\.\.\.|==|!=|<=|>=|<<=|>>=|<<|>>|[-+*/%&|^@]=",
    number=r"(?i)0x[\da-f_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(\.[\d_]*)?(e[+-]?\d[\d_]*)?j?|\.\d[\d_]*(e[+-]?\d+)?j?",
    values="True False None",
    words="and as assert async await class def del elif except for from global if import in is lambda nonlocal not or raise while with",
    ending="break continue pass return yield else try finally raise",
    soft="match case type",
    binary=_ASSIGN + " **= //= >> << @= -> := & | ^ %",
    other="+ - * ** / // ~ @ < > ...",
    allowed=("S S",),
    barred=("B EOL", "P EOL", "K EOL", ". EOL", "I {", "V {", "S {", ") {", "] {", "{ ;", "( ;", "[ ;"),
    lines=True,
    productions={
        "import": r"import I(?: \. I)*(?: as I)?(?: , I(?: \. I)*+(?: as I)?+)*+",
        "from": r"from (?:\. |\.\.\. )*+(?:I (?:\. I )*)?import (?:\*|\(\)|I(?: as I)?(?: , I(?: as I)?+)*+)",
        "def": r"def I (?:\[\] )?\(\) (?:-> .+ )?:(?: .+)?",
        "class": r"class I (?:\[\] )?(?:\(\) )?:(?: .+)?",
        "async": r"async (?:def I (?:\[\] )?\(\) (?:-> .+ )?|for .+ in .+ |with .+ ):(?: .+)?",
        "if": r"if .+ :(?: .+)?",
        "elif": r"elif .+ :(?: .+)?",
        "while": r"while .+ :(?: .+)?",
        "for": r"for .+ in .+ :(?: .+)?",
        "with": r"with .+ :(?: .+)?",
        "else": r"else :(?: .+)?",
        "try": r"try :(?: .+)?",
        "finally": r"finally :(?: .+)?",
        "except": r"except (?:\* )?(?:.+ )?:(?: .+)?",
        "raise": r"raise(?: .+)?",
        "del": r"del .+",
        "global": r"global I(?: , I)*",
        "nonlocal": r"nonlocal I(?: , I)*",
        "assert": r"assert .+",
        "return": r"return(?: (?!.* if (?!.* else )).+)?",
        "pass": r"pass",
        "break": r"break",
        "continue": r"continue",
        "@": r"@ .+",
    },
    default=r"(?!(?:as|in|is|and|or|\)|\]|\}|[=,.:/%<>&|^]) ?)(?!.* (?:def|class|import|raise|while|with|elif|try|except) )(?!.* if (?!.* else )).+",
)

GO = Grammar(
    name="go",
    comment=rf"{_LINE}|{_BLOCK}",
    string=r"\"[^\"\n]*+\"|`[^`]*+`|'[^'\n]{1,12}'",
    name_pattern=_IDENT,
    operators=rf":=|<-|&\^=|&\^|{_C_OPS}",
    number=r"(?i)0x[\da-f_]*(\.[\da-f_]*)?(p[+-]?\d+)?i?|0b[01_]+i?|0o?[0-7_]+i?|\d[\d_]*\.?[\d_]*(e[+-]?\d+)?i?|\.\d[\d_]*(e[+-]?\d+)?i?",
    words="chan const func import interface map package range struct type var",
    heads="case defer for go goto if select switch",
    unfinished="I N S ) ] }",
    ending="break continue default fallthrough",
    alternative="else",
    returns="return",
    before_alternative="}",
    after_alternative="H {",
    loop_parts=(0,),
    binary=_ASSIGN + " := &^= / % || >> << &^",
    other="+ - * & | ^ ! < > <- ++ -- && ~ ...",
    allowed=("I I", ") I", "] I", "I S", "B EOL"),
    barred=("E E", "R E", "K }", "H }", "H )", "H ]", "H ,", "B H", "P H", ". H", ", H", "( H", "[ H"),
    triples=("I I I", "H EOL }", "K EOL }"),
    lines=True,
    carries="B , . P K H",
    productions={
        "package": r"package I",
        "import": r"import (?:\(\)|(?:I |\. )?S)",
        "func": r"func (?:\(\) )?I (?:\[\] )?\(\)(?: .*)?",
        "type": r"type (?:\(\)|I .+)",
        "var": r"var (?:\(\)|I(?: , I)* .+)",
        "const": r"const (?:\(\)|I(?: , I)*(?: .+)?)",
    },
    default=r"(?!)",
    first="package",
)

RUST = Grammar(
    name="rust",
    comment=rf"{_LINE}|{_BLOCK}",
    string=r"(?<!\w)b?r##\"[\s\S]*?\"##|(?<!\w)b?r#\"[\s\S]*?\"#|(?<!\w)(?:b|c)?r?\"[^\"]*+\"|(?<!\w)b?'(?:[^'\n\u0001]|\u0001\u0001[^'\n]{0,10})'|'[\p{L}_]\w*+",
    name_pattern=rf"r#{_IDENT}|{_IDENT}",
    operators=rf"\.\.=|\.\.\.|\.\.|::|->|=>|{_C_OPS}",
    number=r"0x[\da-fA-F_]+([iu](8|16|32|64|128|size))?|0b[01_]+([iu](8|16|32|64|128|size))?|0o[0-7_]+([iu](8|16|32|64|128|size))?|\d[\d_]*(\.[\d_]*)?([eE][+-]?[\d_]+)?_?([iuf](8|16|32|64|128|size))?",
    number_token=r"(?:\d\w*+\.\d\w*+|\d\w*+)(?:(?<=\d[eE])[+-]\w++)?",
    values="self Self super crate true false",
    words="as async await const dyn enum extern fn for if impl in mod move mut pub ref static struct trait type unsafe use where",
    heads="let loop match while",
    unfinished="N S",
    ending="break continue return",
    alternative="else",
    after_alternative="K {",
    members=True,
    soft="union macro_rules default auto",
    binary=_ASSIGN + " % <<",
    other="+ - * / & && | || ! ? < > >> -> => :: .. ..= ... ^ # @ $ ++ -- ~ _",
    allowed=("] I", ". N", "B ,", "B }"),
    barred=("B ,", "B }", "H }", "K }", "I H", ") H", "V H", "I E", ") E", "V E", ", O", "; O", "( O", "[ O"),
    productions={
        "use": r"use (?::: )?[^()\[\]]+ ;",
        "fn": r".*fn I (?:< .+ > )?\(\) (?:-> .+ )?(?:where .+ )?(?:\{\}|;)",
        "struct": r".*struct I (?:< .+ > )?(?:where .+ )?(?:\(\) (?:where .+ )?;|\{\}|;)",
        "enum": r".*enum I (?:< .+ > )?(?:where .+ )?\{\}",
        "trait": r".*trait I .*\{\}",
        "impl": r"(?:unsafe )?impl .+ \{\}",
        "mod": r"mod I (?:;|\{\})",
        "const": r"const (?:I|_|mut I) : .+ = .+ ;|(?:async |unsafe |const |extern (?:S )?+)*+fn .+",
        "static": r"static (?:mut )?I : .+ = .+ ;",
        "type": r"type I .*= .+ ;",
        "extern": r"extern crate .+ ;|extern (?:S )?(?:fn .+|\{\})",
        "unsafe": r"unsafe (?:extern S )?(?:fn|impl|trait|\{\}) ?.*(?:\{\}|;)",
        "async": r"async fn .+",
        "macro_rules": r"macro_rules ! I (?:\{\}|\(\) ;|\[\] ;)",
        "union": r"union I .*\{\}",
    },
    default=r"I (?::: I )*! (?:I )?(?:\{\}|\(\) ;|\[\] ;)|;",
    block_goes_on="; . ? , = as :: )",
)

_JS_WORDS = "catch class const delete extends finally function import in instanceof let new typeof void with"
_JS_HEADS = {
    "if": r"if \(\) .+",
    "for": r"for (?:await )?\(\) .+",
    "while": r"while \(\) .*",
    "switch": r"switch \(\) \{\}(?: .+)?",
    "try": r"try \{\}(?: .+)?",
    "catch": r"catch (?:\(\) )?\{\}(?: .+)?",
    "finally": r"finally \{\}(?: .+)?",
    "else": r"else .+",
    "do": r"do .+",
    "throw": r"throw .+",
    "let": r"let (?:I|\{\}|\[\])(?: .+)?",
    "var": r"var (?:I|\{\}|\[\])(?: .+)?",
}
_JS_FROM = r"(?:I|\{\}|\* as I|I , \{\}|I , \* as I)"


def _script(name: str, typed: bool) -> Grammar:
    kind = r"(?: : (?:(?! = ).)+)?" if typed else ""
    generic = r"(?:< .+ > )?" if typed else ""
    pre = r"(?:export (?:default )?)?" + (r"(?:declare )?" if typed else "")
    own = {
        "function": rf"{pre}(?:async )?function (?:\* )?(?:[Ia-z]+ )?{generic}\(\)" + (r"(?: : .+?)? (?:\{\}|;)" if typed else r" \{\}") + r"(?: .+)?",
        "class": rf"{pre}" + (r"(?:abstract )?" if typed else "") + rf"class (?:I )?{generic}(?:extends .+? )?" + (r"(?:implements .+? )?" if typed else "") + r"\{\}(?: .+)?",
        "const": rf"(?:export )?" + (r"(?:declare )?" if typed else "") + rf"const (?:I|of|from|as|get|set|\{{\}}|\[\]){kind} = .+" + (r"|(?:export )?(?:declare )?const enum I \{\}|(?:export )?declare const I : .+" if typed else ""),
        "import": rf"import (?:S|{_JS_FROM} from S)(?: (?:with|assert) \{{\}})?(?: ;)?|import (?:\(\)|\.) ?.*" + (rf"|import type {_JS_FROM} from S(?: ;)?|import (?:type )?I = .+" if typed else ""),
        "export": r"export (?:default .+|\{\}(?: from S)?(?: ;)?|\* (?:as (?:I|default) )?from S(?: ;)?|(?:const|let|var|async|function|class) .+" + (r"|(?:interface|type|enum|abstract|declare|namespace|import|module) .+|= .+|as namespace I.*" if typed else "") + ")",
    } | _JS_HEADS
    if typed:
        own |= {"interface": rf"{pre}interface I {generic}(?:extends .+ )?\{{\}}(?: .+)?", "enum": rf"{pre}(?:const )?enum I \{{\}}(?: .+)?", "namespace": r"(?:export )?(?:declare )?namespace I(?: \. I)* \{\}(?: .+)?"}
    return Grammar(
        name=name,
        comment=rf"\A#![^\n]*+|{_LINE}|{_BLOCK}",
        string=r"\"[^\"\n]*+\"|'[^'\n]*+'|`[^`]*+`|(?<=[=(,:\[!&|?{};]|return|[=(,:\[!&|?{};] )/(?![*/ ])[^/\n]++/[a-z]*+",
        name_pattern=r"[\p{L}_$#][\p{L}\p{M}\p{N}_$]*+",
        operators=rf">>>=|>>>|===|!==|\*\*=|\*\*|=>|\?\?=|\?\?|\?\.(?!\d)|&&=|\|\|=|{_C_OPS}",
        number=r"(?i)0x[\da-f_]+n?|0b[01_]+n?|0o[0-7_]+n?|\d[\d_]*\.?[\d_]*(e[+-]?\d+)?n?|\.\d[\d_]*(e[+-]?\d+)?",
        values="this super true false null undefined",
        words=_JS_WORDS + (" enum" if typed else ""),
        heads="case do for if switch throw try var while",
        unfinished="I V N S T ]",
        ending="break continue debugger default",
        alternative="else",
        returns="return",
        members=True,
        loop_parts=(0, 2),
        parts_elsewhere=False,
        soft="of from as get set static async await export yield" + (" type interface declare namespace abstract readonly keyof infer is asserts public private protected override implements module unique satisfies" if typed else ""),
        binary=_ASSIGN + " === !== / % & | ^ && || ?? ??= ||= &&= >>>= **= ** << => ?." + ("" if typed else " >> >>>"),
        other="+ - * ! ~ ? < > ++ -- ... @" + (" ? | & >> >>>" if typed else ""),
        allowed=(") I", ") V", ") N", ") S", ") T", "I T", "] T", ", ,", "[ ,", "B EOL", "} B", *(("( B", "] I", "; B", "[ B") if typed else ())),
        barred=("K H", "K R", "K E", "K O", "H }", "O }", "O )", "O ]", "O ,", "O B", "O .", "O O", "E E", "R E", ", O", "( O", "[ O", "B O", "P O"),
        triples=("H EOL }", "O EOL }", "K EOL }"),
        lines=True,
        carries="B , . P K H :",
        productions=own,
        default=r"(?!(?:[,.)*/%=<>|^?:\]}]|&&|=>|\|\||extends|instanceof|in|case|typeof$|new$|delete$|void$) ?).+",
    )


JS = _script("js", False)
TS = _script("ts", True)

C = Grammar(
    name="c",
    comment=rf"{_LINE}|{_BLOCK}",
    directive=r"(?m:^[ \t]*+#[^\n]*+)",
    valid_directive=r"^\s*#\s*(?:include\s*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*)\s*(?:/[/*].*)?$|define\s+[A-Za-z_]|undef\s+[A-Za-z_]|ifn?def\s+[A-Za-z_]|if\b.*\S|elif\b|else\b|endif\b|pragma\b|error\b|warning\b|line\b|embed\b|$)",
    string=r"(?:(?<!\w)(?:u8|[LuU]))?(?:\"[^\"\n]*+\"|'[^'\n]{1,12}')",
    name_pattern=_IDENT,
    operators=_C_OPS,
    number=r"(?i)(0x[\da-f']*(\.[\da-f]*)?(p[+-]?\d+)?|0b[01']+|\d[\d']*\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?)[ulfz]*",
    words="enum sizeof struct typedef union",
    heads="case do for goto if switch while",
    unfinished="N S",  # a name may be a macro
    ending="break continue default",
    alternative="else",
    returns="return",
    loop_parts=(2,),
    parts_elsewhere=False,
    binary=_ASSIGN + " / % | ^ && || << >> -> ?",
    other="+ - * & ! ~ < > ++ -- ...",
    allowed=("I I", ") I", ") N", ") S", "S S", "S I", "I S", "I (", "] I"),
    barred=(", )", ", ]", ": :", "? ;", "B :", "P :", "S .", "K }", "H }", "H ]", "B H", "P H", "O }", "O )", "O ]", "O ,", "O B", "O O", "B O", "P O", ", O", "( O", "[ O", "{ O", *(f"E {x}" for x in ("I", "N", "S", "K", "E")), "R E"),
    soft="auto char const double extern float inline int long register restrict short signed static unsigned void volatile",
    few_names=True,
    triples=("I I H", "I I O", "I I R", "I I E", "Q I H", "Q I O", "Q I R", "Q I E"),
    productions={
        "typedef": r"typedef (?:(?:struct|union|enum) (?:I )?(?:\{\} )?|[I*,] |\(\) |\[\] |: N )++;",
    },
    default=r"(?:(?:struct|union|enum) (?:I )?(?:\{\} )?|[I*] |\(\) |\[\] )*+(?<=I \(\) |\(\) \(\) )\{\}|(?!I ;)(?:(?:struct|union|enum) (?:I )?(?:\{\} )?|[I*,] |\(\) |\[\] |= (?:[^,; ]+ )++)++;|;",
    block_after=("()",),
    block_goes_on="; ,",
)

_CS_MODS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|unsafe|file|new|async|extern|virtual|override) )*+"
CSHARP = Grammar(
    name="csharp",
    comment=rf"{_LINE}|{_BLOCK}",
    directive=r"(?m:^[ \t]*+#[^\n]*+)",
    valid_directive=r"^\s*#\s*(?:region|endregion|if\s+\S|elif\s+\S|else|endif|nullable|pragma|define\s+\w|undef\s+\w|line|error|warning)\b.*$",
    string=r"(?:\$@|@\$|@)\"[^\"]*+\"|\${0,2}\"\"\"[\s\S]*?\"\"\"|\$?\"[^\"\n]*+\"|'[^'\n]{1,8}'",
    name_pattern=rf"@?{_IDENT}",
    operators=rf"=>|\?\?=|\?\?|\?\.|::|\.\.|{_C_OPS}",
    number=r"(?i)(0x[\da-f_]+|0b[01_]+|\d[\d_]*\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?)[ulfdm]*",
    values="this base true false null",
    words="as case catch class delegate do enum event explicit finally fixed implicit in interface is namespace new operator out params ref stackalloc struct switch throw try typeof using public private protected internal static sealed abstract partial readonly unsafe const override virtual extern async",
    heads="for foreach goto if lock while",
    unfinished="N S",
    ending="break continue default",
    alternative="else",
    returns="return",
    before_alternative="} ; D",
    members=True,
    loop_parts=(2,),
    parts_elsewhere=False,
    soft="record where when var await not and or file required add remove get set init yield from select orderby group into join let on equals by ascending descending partial global alias unmanaged scoped managed nameof with",
    binary=_ASSIGN + " / % | ^ && || << -> => ?? ??= :: ?.",
    other="+ - * & ! ~ ? < > >> ++ -- ..",
    allowed=("I I", ") I", ") V", ") N", ") S", "] I", "S S", "> I", ". .", "V I", "I V"),
    barred=(", )", ": :", "I N", "V N", "I H", "V H", "] H", "I R", "V R", "I E", "V E", "] R", "O }", "O )", "O ]", "O ,", "O B", "O O", "H }", "H )", "H ]", "B H", ", H", "( H", "[ H"),
    triples=("I I I",),
    productions={
        "using": r"using (?:static )?(?:I = )?I(?: (?:\. I|:: I))*+(?: < .+ >(?: (?:\. I|:: I))*+)? ;|using (?:var |I )?.+ = .+ ;|using \(\) .*",
        "namespace": r"namespace I(?: \. I)* (?:;|\{\})",
        "type": rf"(?:\[\] )*{_CS_MODS}(?:class|struct|interface|enum|record|record struct|record class) I .*?(?:\{{\}}|;)|(?:\[\] )*{_CS_MODS}delegate .+ \(\) .*;|(?:\[\] )*{_CS_MODS}(?:class|struct|interface|enum|record|record struct) I \{{\}}",
    },
    default=r"extern I I ;|(?:\[\] )+|(?:var|await|const|return|throw) .+ ;|I (?:(?:\. I|\[\]|\(\)|\?|!) )++(?:(?:[-+*/%&|^]?=|\?\?=) .+ )?;|I [-+*/%&|^]?= .+ ;|I (?:< .+ > )?(?:\[\] |\? )?I (?:= .+ )?;|(?:if|for|foreach|while|switch|lock|fixed) \(\) .+|(?:try|else|do|finally|catch|unsafe) .+|(?:static |async )*+I (?:< .+ > )?(?:\[\] |\? )?I \(\) .+|\{\}|;",
    block_goes_on="; . , ) =",
)

GRAMMARS = {g.name: g for g in (PYTHON, GO, RUST, JS, TS, C, CSHARP)}
