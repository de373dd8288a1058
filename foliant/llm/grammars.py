"""Grammars of the seven languages, in the notation of derivatives.py, as far as their syntax goes: names, types and
placement rules that compilers check later are left out. Fixed values: the languages' own keywords and operators."""

from __future__ import annotations

from functools import lru_cache

from foliant.llm.derivatives import Grammar

PYTHON_HARD = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
PYTHON_SOFT = "match case _".split()
PYTHON = r"""
file = { NEWLINE | stmt } ;
stmt = compound | simple ;
simple = small { ';' small } [ ';' ] NEWLINE ;
small = 'pass' | 'break' | 'continue' | 'return' [ exprs ] | 'raise' [ expr [ 'from' expr ] ] | 'global' NAME { ',' NAME } | 'nonlocal' NAME { ',' NAME }
  | 'del' deltargets | 'assert' expr [ ',' expr ] | import | assignment ;
deltargets = deltarget { ',' deltarget } [ ',' ] ;
deltarget = lvalue | '(' [ deltargets ] ')' | '[' [ deltargets ] ']' ;
import = 'import' dotted [ 'as' NAME ] { ',' dotted [ 'as' NAME ] }
  | 'from' ( dots [ dotted ] | dotted ) 'import' ( '*' | importas { ',' importas } | '(' importas { ',' importas } [ ',' ] ')' ) ;
dots = ( '.' | '...' ) { '.' | '...' } ;
dotted = NAME { '.' NAME } ;
importas = NAME [ 'as' NAME ] ;
assignment = exprs | targets '=' { targets '=' } ( exprs | yield ) | single ':' expr [ '=' ( exprs | yield ) ] | single AUG ( exprs | yield ) | yield ;
single = lvalue | '(' single ')' ;
targets = startarget { ',' startarget } [ ',' ] ;
startarget = [ '*' ] target ;
target = lvalue | '(' [ targets ] ')' | '[' [ targets ] ']' ;
lvalue = NAME | [ 'await' ] atom { trailer } ( '.' NAME | '[' slices ']' ) ;
exprs = starexpr { ',' starexpr } [ ',' ] ;
starexpr = '*' bitor | expr ;
yield = 'yield' [ 'from' expr | exprs ] ;
named = NAME ':=' expr | expr ;
starnamed = '*' bitor | named ;
expr = disjunction [ 'if' disjunction 'else' expr ] | lambda ;
lambda = 'lambda' [ lparams ] ':' expr ;
disjunction = inversion { ( 'and' | 'or' ) inversion } ;
inversion = { 'not' } bitor { compare bitor } ;
compare = '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' [ 'not' ] ;
bitor = unary { BIN unary } ;
unary = { '+' | '-' | '~' } power ;
power = [ 'await' ] atom { trailer } [ '**' unary ] ;
trailer = '.' NAME | '(' [ args ] ')' | '[' slices ']' ;
slices = slice { ',' slice } [ ',' ] ;
slice = [ expr ] ':' [ expr ] [ ':' [ expr ] ] | named | '*' bitor ;
atom = NAME | 'True' | 'False' | 'None' | NUM | STR { STR } | '...' | '(' [ inparens ] ')' | '[' [ inlist ] ']' | '{' [ inbraces ] '}' ;
inparens = yield | starnamed { ',' starnamed } [ ',' ] | named comp ;
inlist = starnamed { ',' starnamed } [ ',' ] | named comp ;
inbraces = starnamed { ',' starnamed } [ ',' ] | named comp | pair { ',' pair } [ ',' ] | expr ':' expr comp ;
pair = expr ':' expr | '**' bitor ;
comp = compfor { compfor } ;
compfor = [ 'async' ] 'for' targets 'in' disjunction { 'if' disjunction } ;
args = named comp | positional { ',' positional } [ ',' [ keywords ] ] | keywords ;
positional = '*' expr | named ;
keywords = NAME '=' expr { ',' kwarg } [ ',' ] | '**' expr { ',' kwafter } [ ',' ] ;
kwarg = NAME '=' expr | '*' expr | '**' expr ;
kwafter = NAME '=' expr | '**' expr ;
params = plist ;
plist = pitem { ',' pitem } [ ',' [ pstar ] ] | pstar ;
pitem = NAME [ ':' expr ] [ '=' expr ] | '/' ;
pstar = '*' NAME [ ':' expr ] { ',' pkey } [ ',' [ pdouble ] ] | '*' ',' pkey { ',' pkey } [ ',' [ pdouble ] ] | pdouble ;
pkey = NAME [ ':' expr ] [ '=' expr ] ;
pdouble = '**' NAME [ ':' expr ] [ ',' ] ;
lparams = litem { ',' litem } [ ',' [ lstar ] ] | lstar ;
litem = NAME [ '=' expr ] | '/' ;
lstar = '*' NAME { ',' lkey } [ ',' [ ldouble ] ] | '*' ',' lkey { ',' lkey } [ ',' [ ldouble ] ] | ldouble ;
lkey = NAME [ '=' expr ] ;
ldouble = '**' NAME [ ',' ] ;
block = NEWLINE INDENT stmt { stmt } DEDENT | simple ;
compound = { decorator } ( [ 'async' ] def | class ) | if | while | [ 'async' ] for | try | [ 'async' ] with | matching ;
decorator = '@' named NEWLINE ;
def = 'def' NAME '(' [ params ] ')' [ '->' expr ] ':' block ;
class = 'class' NAME [ '(' [ args ] ')' ] ':' block ;
if = 'if' named ':' block { 'elif' named ':' block } [ 'else' ':' block ] ;
while = 'while' named ':' block [ 'else' ':' block ] ;
for = 'for' targets 'in' exprs ':' block [ 'else' ':' block ] ;
try = 'try' ':' block ( 'finally' ':' block | except { except } [ 'else' ':' block ] [ 'finally' ':' block ] ) ;
except = 'except' [ expr [ 'as' NAME ] ] ':' block ;
with = 'with' ( withitem { ',' withitem } | '(' withitem { ',' withitem } [ ',' ] ')' ) ':' block ;
withitem = expr [ 'as' target ] ;
matching = 'match' subject ':' NEWLINE INDENT case { case } DEDENT ;
subject = starnamed { ',' starnamed } [ ',' ] ;
case = 'case' patterns [ 'if' named ] ':' block ;
patterns = maybestar { ',' maybestar } [ ',' ] ;
maybestar = '*' NAME | pattern ;
pattern = closed { '|' closed } [ 'as' NAME ] ;
closed = [ '-' ] NUM [ BIN NUM ] | STR { STR } | 'None' | 'True' | 'False' | dotted [ '(' [ cargs ] ')' ] | '(' [ patterns ] ')' | '[' [ patterns ] ']' | '{' [ mitems ] '}' ;
cargs = carg { ',' carg } [ ',' ] ;
carg = pattern | NAME '=' pattern ;
mitems = mitem { ',' mitem } [ ',' ] ;
mitem = ( [ '-' ] NUM | STR { STR } | 'None' | 'True' | 'False' | NAME '.' dotted ) ':' pattern | '**' NAME ;
fline = exprs NEWLINE ;
"""

C_WORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local".split()
C = r"""
unit = { external } ;
external = specs ( ';' | initdecls ';' | declarator { attribute } block ) | staticassert | asm ';' | ';' ;
staticassert = '_Static_assert' '(' assign ',' STR { STR } ')' ';' ;
asm = ASM '(' { asmpart } ')' ;
asmpart = STR | ':' | ',' | '[' NAME ']' | '(' expr ')' ;
specs = { qual } ( NAME { qual } | builtin { builtin | qual } | aggregate { qual } ) ;
qual = 'const' | 'volatile' | 'restrict' | 'static' | 'extern' | 'typedef' | 'auto' | 'register' | 'inline' | '_Noreturn' | '_Thread_local' | '_Atomic'
  | '_Alignas' '(' ( typename | assign ) ')' | attribute ;
attribute = ATTRIBUTE '(' '(' { attr | ',' } ')' ')' ;
attr = ( NAME | 'const' ) [ '(' [ args ] ')' ] ;
builtin = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | '_Atomic' '(' typename ')' ;
aggregate = ( 'struct' | 'union' ) { attribute } ( NAME [ '{' { field } '}' ] | '{' { field } '}' ) { attribute } | 'enum' { attribute } ( NAME [ enumbody ] | enumbody ) ;
enumbody = '{' enumerator { ',' enumerator } [ ',' ] '}' ;
enumerator = NAME [ '=' conditional ] ;
field = specs [ fielddecl { ',' fielddecl } ] ';' | staticassert ;
fielddecl = declarator [ ':' conditional ] { attribute } | ':' conditional ;
initdecls = initdecl { ',' initdecl } ;
initdecl = declarator [ asm ] { attribute } [ '=' init ] ;
init = assign | '{' [ inititem { ',' inititem } [ ',' ] ] '}' ;
inititem = [ designator { designator } '=' ] init ;
designator = '.' NAME | '[' conditional [ '...' conditional ] ']' ;
pointer = '*' { 'const' | 'volatile' | 'restrict' | '_Atomic' | attribute } ;
declarator = { pointer } direct ;
direct = ( NAME | '(' { attribute } declarator ')' ) { suffix } ;
suffix = '[' { 'static' | 'const' | 'volatile' | 'restrict' } [ assign | '*' ] ']' | '(' [ params ] ')' ;
params = NAME { ',' NAME } | param { ',' param } [ ',' '...' ] ;
param = specs [ declarator | abstract ] { attribute } ;
abstract = pointer { pointer } [ directabs ] | directabs ;
directabs = '(' abstract ')' { suffix } | suffix { suffix } ;
typename = specs [ abstract ] ;
block = '{' { item } '}' ;
item = declaration | statement ;
declaration = specs [ initdecls ] ';' | staticassert ;
statement = NAME ':' { attribute } ( statement | ) | 'case' conditional [ '...' conditional ] ':' statement | 'default' ':' statement | block | [ expr ] ';'
  | 'if' '(' expr ')' statement [ 'else' statement ] | 'switch' '(' expr ')' statement | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' ( declaration | [ expr ] ';' ) [ expr ] ';' [ expr ] ')' statement | 'goto' NAME ';' | 'continue' ';' | 'break' ';' | 'return' [ expr ] ';'
  | ASM { 'volatile' | 'inline' | 'goto' } '(' { asmpart } ')' ';' ;
expr = assign { ',' assign } ;
assign = unary ASSIGN assign | conditional ;
conditional = cast { BIN cast } [ '?' [ expr ] ':' conditional ] ;
cast = '(' typename ')' cast | unary ;
unary = postfix | ( '++' | '--' ) unary | UNARY cast | 'sizeof' ( unary | '(' typename ')' ) | '_Alignof' '(' typename ')' ;
postfix = ( primary | '(' typename ')' '{' [ inititem { ',' inititem } [ ',' ] ] '}' ) { '[' expr ']' | '(' [ args ] ')' | '.' NAME | '->' NAME | '++' | '--' } ;
args = arg { ',' arg } ;
arg = assign | typename ;
primary = NAME | NUM | CHAR | STR { STR | NAME STR } | '(' expr ')' | '(' block ')' | '_Generic' '(' assign ',' generic { ',' generic } ')' ;
generic = ( typename | 'default' ) ':' assign ;
"""

GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
GO = r"""
file = 'package' NAME ';' { import ';' } { top ';' } ;
import = 'import' ( importspec | '(' [ importspec { ';' importspec } [ ';' ] ] ')' ) ;
importspec = [ NAME | '.' ] STR ;
top = decl | 'func' [ '(' [ plist ] ')' ] NAME [ tparams ] signature [ block ] ;
decl = 'const' ( constspec | '(' [ constspec { ';' constspec } [ ';' ] ] ')' ) | 'var' ( varspec | '(' [ varspec { ';' varspec } [ ';' ] ] ')' )
  | 'type' ( typespec | '(' [ typespec { ';' typespec } [ ';' ] ] ')' ) ;
constspec = names [ [ type ] '=' exprs ] ;
varspec = names ( type [ '=' exprs ] | '=' exprs ) ;
typespec = NAME [ tparams ] [ '=' ] type ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = names constraint ;
constraint = [ '~' ] type { '|' [ '~' ] type } ;
names = NAME { ',' NAME } ;
signature = '(' [ plist ] ')' [ '(' [ plist ] ')' | type ] ;
plist = param { ',' param } [ ',' ] ;
param = NAME [ '...' ] type | [ '...' ] type ;
type = NAME [ '.' NAME ] [ '[' type { ',' type } [ ',' ] ']' ] | '(' type ')' | '*' type | '[' ( expr | '...' | ) ']' type | 'map' '[' type ']' type
  | 'chan' [ '<-' ] type | '<-' 'chan' type | 'func' signature | 'struct' '{' [ field { ';' field } [ ';' ] ] '}' | 'interface' '{' [ method { ';' method } [ ';' ] ] '}' ;
field = ( names type | [ '*' ] NAME [ '.' NAME ] [ '[' type { ',' type } [ ',' ] ']' ] ) [ STR ] ;
method = NAME signature | constraint ;
block = '{' stmts '}' ;
stmts = [ stmt ] { ';' [ stmt ] } ;
stmt = decl | NAME ':' [ stmt ] | simple | 'go' expr | 'defer' expr | 'return' [ exprs ] | 'break' [ NAME ] | 'continue' [ NAME ] | 'goto' NAME | 'fallthrough' | block
  | if | 'switch' [ [ simple ] ';' ] [ switchhead ] '{' { ( 'case' cases | 'default' ) ':' stmts } '}' | 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}'
  | 'for' [ forhead ] block ;
cases = caseitem { ',' caseitem } ;
caseitem = expr | type ;
switchhead = [ NAME ':=' ] primary '.' '(' 'type' ')' | expr ;
if = 'if' [ [ simple ] ';' ] expr block [ 'else' ( if | block ) ] ;
forhead = expr | [ simple ] ';' [ expr ] ';' [ simple ] | [ exprs ( ':=' | '=' ) ] 'range' expr ;
simple = expr ( '++' | '--' ) | exprs [ ( ':=' | ASSIGN ) exprs ] | expr '<-' expr ;
exprs = expr { ',' expr } ;
expr = unary { BIN unary } ;
unary = { UNARY } primary ;
primary = operand { '.' NAME | '.' '(' type ')' | '[' index ']' | '(' [ callargs ] ')' } ;
index = [ expr ] ':' [ expr ] [ ':' expr ] | ( expr | type ) { ',' ( expr | type ) } [ ',' ] ;
callargs = ( expr | type ) { ',' ( expr | type ) } [ '...' ] [ ',' ] ;
operand = NUM | STR | CHAR | NAME [ '.' NAME ] [ '[' type { ',' type } [ ',' ] ']' ] literal | NAME | 'func' signature block | '(' ( expr | type ) ')' | littype literal | convtype '(' expr [ ',' ] ')' ;
littype = '[' ( expr | '...' | ) ']' type | 'map' '[' type ']' type | 'struct' '{' [ field { ';' field } [ ';' ] ] '}' ;
convtype = '[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' [ '<-' ] type | 'interface' '{' [ method { ';' method } [ ';' ] ] '}' | 'func' signature ;
literal = '{' [ element { ',' element } [ ',' ] ] '}' ;
element = [ ( expr | literal ) ':' ] ( expr | literal ) ;
"""

JAVA_HARD = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
JAVA_SOFT = "var yield record sealed permits non when module open opens requires exports uses provides to with transitive".split()
JAVA = r"""
unit = [ { annotation } 'package' qname ';' ] { 'import' [ 'static' ] NAME { '.' NAME } [ '.' '*' ] ';' | ';' } { typedecl | ';' } ;
qname = NAME { '.' NAME } ;
annotation = '@' qname [ '(' [ annoargs ] ')' ] ;
annoargs = NAME '=' annovalue { ',' NAME '=' annovalue } | annovalue ;
annovalue = conditional | annotation | '{' [ annovalue { ',' annovalue } ] [ ',' ] '}' ;
modifier = annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
typedecl = { modifier } ( class | interface | enum | record | annotype ) ;
class = 'class' NAME [ tparams ] [ 'extends' type ] [ 'implements' types ] [ 'permits' types ] classbody ;
interface = 'interface' NAME [ tparams ] [ 'extends' types ] [ 'permits' types ] classbody ;
annotype = '@' 'interface' NAME classbody ;
enum = 'enum' NAME [ 'implements' types ] '{' [ constant { ',' constant } ] [ ',' ] [ ';' { member } ] '}' ;
constant = { annotation } NAME [ '(' [ args ] ')' ] [ classbody ] ;
record = 'record' NAME [ tparams ] '(' [ component { ',' component } ] ')' [ 'implements' types ] classbody ;
component = { annotation } type [ '...' ] NAME ;
tparams = '<' tparam { ',' tparam } '>' ;
tparam = { annotation } NAME [ 'extends' type { '&' type } ] ;
types = type { ',' type } ;
classbody = '{' { member } '}' ;
member = ';' | { modifier } block | { modifier } ( class | interface | enum | record | annotype ) | { modifier } [ tparams ] ( ( 'void' | type ) NAME method | NAME '(' [ params ] ')' [ throws ] block | NAME block )
  | { modifier } type NAME { dims } [ '=' varinit ] { ',' NAME { dims } [ '=' varinit ] } ';' ;
method = '(' [ params ] ')' { dims } [ throws ] [ 'default' annovalue ] ( block | ';' ) ;
throws = 'throws' types ;
params = param { ',' param } ;
param = { 'final' | annotation } type { annotation } [ '...' ] ( NAME { dims } | [ NAME '.' ] 'this' ) ;
dims = { annotation } '[' ']' ;
prim = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' ;
type = { annotation } ( prim | named ) { dims } ;
named = NAME [ targs ] { '.' { annotation } NAME [ targs ] } ;
targs = '<' [ targ { ',' targ } ] '>' ;
targ = { annotation } '?' [ ( 'extends' | 'super' ) type ] | type ;
varinit = expr | '{' [ varinit { ',' varinit } ] [ ',' ] '}' ;
block = '{' { stmt } '}' ;
localvar = { 'final' | annotation } type NAME { dims } [ '=' varinit ] { ',' NAME { dims } [ '=' varinit ] } ;
stmt = block | ';' | localvar ';' | { modifier } ( class | interface | enum | record ) | NAME ':' stmt | stmtexpr ';' | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'assert' expr [ ':' expr ] ';'
  | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' ( [ localvar | stmtexpr { ',' stmtexpr } ] ';' [ expr ] ';' [ stmtexpr { ',' stmtexpr } ] | { 'final' | annotation } type NAME ':' expr ) ')' stmt
  | 'switch' '(' expr ')' '{' switchbody '}' | 'return' [ expr ] ';' | 'break' [ NAME ] ';' | 'continue' [ NAME ] ';' | 'yield' expr ';' | 'throw' expr ';' | 'synchronized' '(' expr ')' block
  | 'try' ( '(' resource { ';' resource } [ ';' ] ')' block { catch } [ 'finally' block ] | block ( catch { catch } [ 'finally' block ] | 'finally' block ) ) ;
catch = 'catch' '(' { 'final' | annotation } type { '|' type } NAME ')' block ;
resource = { 'final' | annotation } type NAME '=' expr | primary ;
switchbody = { label ':' { label ':' } { stmt } } | { label '->' ( expr ';' | block | 'throw' expr ';' ) } ;
label = 'case' conditional { ',' conditional } | 'default' ;
stmtexpr = lhs ASSIGN expr | ( '++' | '--' ) unary | primary ( '++' | '--' ) | called ;
called = operand { selector } callish | NAME '(' [ args ] ')' | creator { selector } | ( 'this' | 'super' ) '(' [ args ] ')' ;
callish = '.' [ targs ] NAME '(' [ args ] ')' | '.' [ targs ] ( 'super' | 'this' ) '(' [ args ] ')' | '.' creator ;
lhs = primary ;
expr = lambda | lhs ASSIGN expr | conditional ;
lambda = ( NAME | '(' [ lparams ] ')' ) '->' ( expr | block ) ;
lparams = NAME { ',' NAME } | params ;
conditional = binary [ '?' expr ':' ( conditional | lambda ) ] ;
binary = unary { BIN unary | 'instanceof' ( { 'final' | annotation } type [ NAME ] ) } ;
unary = ( '+' | '-' | '++' | '--' | '!' | '~' ) unary | '(' type { '&' type } ')' ( unary | lambda ) | primary { '++' | '--' } | 'switch' '(' expr ')' '{' switchbody '}' ;
primary = operand { selector } ;
operand = NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | NAME [ '(' [ args ] ')' ] | ( 'this' | 'super' ) '(' [ args ] ')' | creator | ( prim | 'void' ) { dims } '.' 'class' | prim dims { dims } '::' 'new'
  | named { dims } '.' 'class' | named { dims } '::' [ targs ] ( NAME | 'new' ) ;
selector = '.' [ targs ] NAME [ '(' [ args ] ')' ] | '.' ( 'this' | 'super' | 'class' ) | '.' 'super' '(' [ args ] ')' | '.' creator | '[' expr ']' | '::' [ targs ] ( NAME | 'new' ) ;
creator = 'new' [ targs ] { annotation } ( named '(' [ args ] ')' [ classbody ] | ( prim | named ) ( '[' expr ']' { '[' expr ']' } { dims } | dims { dims } arrayinit ) ) ;
arrayinit = '{' [ varinit { ',' varinit } ] [ ',' ] '}' ;
args = expr { ',' expr } ;
"""

RUST_HARD = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split()
RUST_SOFT = "union auto macro_rules default".split()
RUST = r"""
file = { inner } { item } ;
inner = '#' '!' '[' { tree } ']' ;
outer = '#' '[' { tree } ']' ;
tree = '(' { tree } ')' | '[' { tree } ']' | '{' { tree } '}' | LEAF ;
item = { outer } ( [ vis ] ( fn | struct | enum | union | trait | impl | mod | use | const | static | alias | externcrate | externblock ) | macroitem ) ;
vis = 'pub' [ '(' ( 'crate' | 'self' | 'super' | 'in' path ) ')' ] ;
macroitem = path '!' [ NAME ] ( '{' { tree } '}' | '(' { tree } ')' ';' | '[' { tree } ']' ';' ) ;
fn = { 'const' | 'async' | 'unsafe' | 'default' | 'extern' [ STR ] } 'fn' NAME [ generics ] '(' [ params ] ')' [ '->' type ] [ where ] ( block | ';' ) ;
params = fparam { ',' fparam } [ ',' ] ;
fparam = { outer } ( [ '&' [ LIFETIME ] ] [ 'mut' ] 'self' [ ':' type ] | pattern ':' ( type | '...' ) | '...' ) ;
generics = '<' [ gparam { ',' gparam } [ ',' ] ] '>' ;
gparam = { outer } ( LIFETIME [ ':' [ LIFETIME { '+' LIFETIME } [ '+' ] ] ] | NAME [ ':' [ bounds ] ] [ '=' type ] | 'const' NAME ':' type [ '=' ( block | [ '-' ] LIT | NAME ) ] ) ;
bounds = bound { '+' bound } [ '+' ] ;
bound = LIFETIME | [ '?' | '~' 'const' ] [ forlife ] typepath | '(' [ '?' ] [ forlife ] typepath ')' ;
forlife = 'for' generics ;
where = 'where' [ clause { ',' clause } [ ',' ] ] ;
clause = LIFETIME ':' [ bounds ] | [ forlife ] type ':' [ bounds ] ;
struct = 'struct' NAME [ generics ] ( [ where ] '{' [ fields ] '}' | '(' [ tfields ] ')' [ where ] ';' | [ where ] ';' ) ;
union = 'union' NAME [ generics ] [ where ] '{' [ fields ] '}' ;
fields = field { ',' field } [ ',' ] ;
field = { outer } [ vis ] NAME ':' type ;
tfields = tfield { ',' tfield } [ ',' ] ;
tfield = { outer } [ vis ] type ;
enum = 'enum' NAME [ generics ] [ where ] '{' [ variant { ',' variant } [ ',' ] ] '}' ;
variant = { outer } [ vis ] NAME [ '{' [ fields ] '}' | '(' [ tfields ] ')' ] [ '=' expr ] ;
trait = [ 'unsafe' ] [ 'auto' ] 'trait' NAME [ generics ] [ ':' [ bounds ] ] [ where ] '{' { inner } { assoc } '}' ;
impl = [ 'default' ] [ 'unsafe' ] 'impl' [ generics ] [ 'const' ] ( [ '!' ] type 'for' ) type [ where ] '{' { inner } { assoc } '}' | [ 'unsafe' ] 'impl' [ generics ] type [ where ] '{' { inner } { assoc } '}' ;
assoc = { outer } ( [ vis ] [ 'default' ] ( fn | const | alias ) | macroitem ) ;
mod = [ 'unsafe' ] 'mod' NAME ( ';' | '{' { inner } { item } '}' ) ;
use = 'use' usetree ';' ;
usetree = [ '::' ] ( '*' | '{' [ usetree { ',' usetree } [ ',' ] ] '}' | useseg { '::' useseg } [ '::' ( '*' | '{' [ usetree { ',' usetree } [ ',' ] ] '}' ) ] [ 'as' ( NAME | '_' ) ] ) ;
useseg = NAME | 'crate' | 'self' | 'super' | 'Self' ;
const = 'const' ( NAME | '_' ) ':' type [ '=' expr ] ';' ;
static = 'static' [ 'mut' ] NAME ':' type [ '=' expr ] ';' ;
alias = 'type' NAME [ generics ] [ ':' [ bounds ] ] [ where ] [ '=' type ] [ where ] ';' ;
externcrate = 'extern' 'crate' ( NAME | 'self' ) [ 'as' ( NAME | '_' ) ] ';' ;
externblock = [ 'unsafe' ] 'extern' [ STR ] '{' { inner } { { outer } ( [ vis ] ( fn | static | alias ) | macroitem ) } '}' ;
seg = NAME | 'self' | 'Self' | 'super' | 'crate' ;
path = [ '::' ] seg { '::' seg } ;
typepath = [ '::' ] typeseg { '::' typeseg } ;
typeseg = seg [ [ '::' ] gargs | '(' [ type { ',' type } [ ',' ] ] ')' [ '->' typenobound ] ] ;
gargs = '<' [ garg { ',' garg } [ ',' ] ] '>' ;
garg = LIFETIME | NAME [ gargs ] ( '=' type | ':' bounds ) | type | [ '-' ] LIT | block ;
qpath = '<' type [ 'as' typepath ] '>' '::' typeseg { '::' typeseg } ;
type = typenobound | [ 'dyn' | 'impl' ] bounds ;
typenobound = typepath [ '!' delim ] | qpath | '&' [ LIFETIME ] [ 'mut' ] typenobound2 | '&&' [ LIFETIME ] [ 'mut' ] typenobound2 | '*' ( 'const' | 'mut' ) typenobound2 | '[' type [ ';' expr ] ']' | '(' [ type { ',' type } [ ',' ] ] ')' | '!' | '_'
  | ( 'dyn' | 'impl' ) bound | [ forlife ] { 'unsafe' | 'extern' [ STR ] } 'fn' '(' [ bare { ',' bare } [ ',' ] ] ')' [ '->' typenobound2 ] | forlife typepath ;
typenobound2 = typenobound ;
bare = { outer } [ NAME ':' | '_' ':' ] type | '...' ;
delim = '(' { tree } ')' | '[' { tree } ']' | '{' { tree } '}' ;
pattern = [ '|' ] pat { '|' pat } ;
pat = [ 'ref' ] [ 'mut' ] NAME [ '@' pat ] | '_' | '..' | rangeend [ ( '..=' | '...' | '..' ) [ rangeend ] ] | ( '..=' | '..' ) rangeend | '&' [ 'mut' ] pat | '&&' [ 'mut' ] pat | '(' [ pattern { ',' pattern } [ ',' ] ] ')' | '[' [ pattern { ',' pattern } [ ',' ] ] ']'
  | epath '(' [ pattern { ',' pattern } [ ',' ] ] ')' | epath '{' [ fpat { ',' fpat } [ ',' ] ] '}' | path '!' delim | 'box' pat | 'const' block ;
rangeend = [ '-' ] LIT | epath ;
fpat = { outer } ( '..' | ( NAME | LIT ) ':' pattern | [ 'box' ] [ 'ref' ] [ 'mut' ] NAME ) ;
epath = [ '::' ] eseg { '::' eseg } | qpath ;
eseg = seg [ '::' gargs ] ;
block = '{' { inner } { stmt } [ { outer } expr ] '}' ;
stmt = ';' | item | { outer } 'let' pattern [ ':' type ] [ '=' expr [ 'else' block ] ] ';' | { outer } expr ';' | { outer } blocklike { methods } [ ';' ] ;
methods = '.' ( NAME [ '::' gargs ] [ '(' [ args ] ')' ] | 'await' ) | '?' ;
blocklike = [ LIFETIME ':' ] ( block | loop ) | 'unsafe' block | 'async' [ 'move' ] block | if | match | path '!' '{' { tree } '}' | 'const' block ;
loop = 'loop' block | 'while' cond block | 'for' pattern 'in' expr block ;
if = 'if' cond block [ 'else' ( if | block ) ] ;
cond = expr ;
match = 'match' expr '{' { inner } [ arms ] '}' ;
arms = { arm } [ { outer } pattern [ 'if' cond ] '=>' expr ] ;
arm = { outer } pattern [ 'if' cond ] '=>' ( expr ',' | blocklike [ ',' ] ) ;
expr = [ 'let' pattern '=' ] rangeexpr { ASSIGN rangeexpr } ;
rangeexpr = operands [ ( '..' | '..=' ) [ operands ] ] | ( '..' | '..=' ) [ operands ] ;
operands = unary { ( BIN | BINPIPE ) [ 'let' pattern '=' ] unary } ;
unary = { '-' | '!' | '*' | '&' [ 'mut' ] | '&&' [ 'mut' ] | 'box' } postfix { 'as' typenobound } | closure | 'return' [ expr ] | 'break' [ LIFETIME ] [ expr ] | 'continue' [ LIFETIME ] | 'yield' [ expr ] ;
closure = { 'static' | 'async' | 'move' | forlife } ( '||' | '|' [ cparam { ',' cparam } [ ',' ] ] '|' ) ( expr | '->' typenobound block ) ;
cparam = { outer } pat [ ':' type ] ;
postfix = primary { '.' ( NAME [ '::' gargs ] | LIT | 'await' ) | '(' [ args ] ')' | '[' expr ']' | '?' } ;
args = { outer } expr { ',' { outer } expr } [ ',' ] ;
primary = LIT | epath [ '!' delim ] | epath '{' [ finit { ',' finit } ] [ ',' ] [ '..' [ expr ] ] '}' | '(' [ args ] ')' | '[' [ args | expr ';' expr ] ']' | blocklike | '_' ;
finit = { outer } ( NAME | LIT ) [ ':' expr ] ;
"""

JS_HARD = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
JS_SOFT = "let static async await of get set yield as from implements interface package private protected public type declare namespace module abstract readonly keyof infer is asserts unique satisfies override require global never unknown any number string boolean symbol object bigint undefined accessor out target meta constructor".split()
JS = r"""
file = { stmt } ;
semi = ';' | ASI ;
stmt = block | var semi | ';' | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'do' stmt 'while' '(' expr ')' ( semi | ) | 'while' '(' expr ')' stmt | for stmt | 'continue' [ NAME ] semi | 'break' [ NAME ] semi | 'return' [ expr ] semi
  | 'with' '(' expr ')' stmt | 'switch' '(' expr ')' '{' { ( 'case' expr | 'default' ) ':' { stmt } } '}' | NAME ':' stmt | 'throw' expr semi | 'try' block ( catch [ 'finally' block ] | 'finally' block ) | 'debugger' semi | ~'{' ~'function' ~'class' expr semi | function | class | extra ;
extra = NEVER ;
block = '{' { stmt } '}' ;
var = ( 'var' | 'let' | 'const' ) binding { ',' binding } ;
binding = ( NAME | bpattern ) ann [ '=' assign ] ;
ann = ;
bpattern = '[' { ',' } [ belem { ',' { ',' } belem } { ',' } ] ']' | '{' [ bprop { ',' bprop } [ ',' ] ] '}' ;
belem = [ '...' ] ( NAME | bpattern ) [ '=' assign ] ;
bprop = NAME [ '=' assign ] | propname ':' ( NAME | bpattern ) [ '=' assign ] | '...' NAME ;
for = 'for' [ 'await' ] '(' ( [ var | exprnoin ] ';' [ expr ] ';' [ expr ] | ( ( 'var' | 'let' | 'const' ) ( NAME | bpattern ) | unary ) ( 'in' expr | 'of' assign ) ) ')' ;
exprnoin = expr ;
catch = 'catch' [ '(' ( NAME | bpattern ) ann ')' ] block ;
function = [ 'async' ] 'function' [ '*' ] NAME tparams fsig block ;
funexpr = [ 'async' ] 'function' [ '*' ] [ NAME ] tparams fsig block ;
tparams = ;
fsig = '(' [ params ] ')' ret ;
ret = ;
params = param { ',' param } [ ',' ] ;
param = [ '...' ] ( NAME | bpattern ) ann [ '=' assign ] ;
class = 'class' NAME classtail ;
classexpr = 'class' [ NAME ] classtail ;
classtail = [ 'extends' postfix ] '{' { member } '}' ;
member = ';' | [ 'static' ] ( method | propname [ '=' assign ] semi ) | 'static' block ;
method = [ 'async' ] [ '*' ] propname tparams fsig block | ( 'get' | 'set' ) propname fsig block ;
propname = WORD | PRIVATE | STR | NUM | '[' assign ']' ;
expr = assign { ',' assign } ;
assign = arrow | unary ASSIGN assign | conditional | yield ;
yield = 'yield' [ [ '*' ] assign ] ;
arrow = [ 'async' ] ( NAME | tparams '(' [ params ] ')' ret ) '=>' ( ~'{' assign | block ) ;
conditional = binary [ '?' assign ':' assign ] ;
binary = unary { ( BIN | 'in' | 'instanceof' ) unary } ;
unary = ( 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await' | '++' | '--' ) unary | PRIVATE 'in' unary | postfix [ '++' | '--' ] ;
postfix = primary { access } ;
access = '.' ( WORD | PRIVATE ) | '?.' ( WORD | PRIVATE | '[' expr ']' | '(' [ args ] ')' | template ) | '[' expr ']' | '(' [ args ] ')' | template ;
args = arg { ',' arg } [ ',' ] ;
arg = [ '...' ] assign ;
template = TEMPLATE | THEAD expr { TMIDDLE expr } TTAIL ;
primary = NAME | NUM | STR | REGEX | 'this' | 'null' | 'true' | 'false' | 'super' | template | '(' expr ')' | array | object | funexpr | classexpr | 'new' ( '.' WORD | newtarget ) | 'import' ( '(' assign [ ',' [ assign ] ] ')' | '.' WORD ) ;
newtarget = primary { '.' ( WORD | PRIVATE ) | '[' expr ']' | template } [ '(' [ args ] ')' ] ;
array = '[' { ',' } [ arg { ',' { ',' } arg } { ',' } ] ']' ;
object = '{' [ property { ',' property } [ ',' ] ] '}' ;
property = propname ':' assign | NAME [ '=' assign ] | method | '...' assign ;
"""
TYPESCRIPT = JS + r"""
extra = import | export | interface | alias | enum | namespace | declare | 'abstract' class | decorator { decorator } [ 'export' [ 'default' ] ] [ 'abstract' ] class ;
import = 'import' ( STR | [ 'type' ] importclause 'from' STR | [ 'type' ] NAME '=' ( 'require' '(' STR ')' | NAME { '.' WORD } ) ) semi ;
importclause = NAME [ ',' ( '*' 'as' NAME | named ) ] | '*' 'as' NAME | named ;
named = '{' [ spec { ',' spec } [ ',' ] ] '}' ;
spec = [ 'type' ] ( WORD | STR ) [ 'as' ( WORD | STR ) ] ;
export = 'export' ( [ 'type' ] ( '*' [ 'as' ( WORD | STR ) ] 'from' STR | named [ 'from' STR ] ) semi | 'default' ( function | 'abstract' class | class | interface | [ 'async' ] 'function' [ '*' ] tparams fsig block | ~'function' ~'class' ~'abstract' ~'interface' assign semi ) | var semi | function | [ 'abstract' ] class
  | interface | alias | enum | namespace | declare | '=' expr semi | 'as' 'namespace' NAME semi | import | overload ) ;
stmt = block | var semi | ';' | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'do' stmt 'while' '(' expr ')' ( semi | ) | 'while' '(' expr ')' stmt | for stmt | 'continue' [ NAME ] semi | 'break' [ NAME ] semi | 'return' [ expr ] semi
  | 'with' '(' expr ')' stmt | 'switch' '(' expr ')' '{' { ( 'case' expr | 'default' ) ':' { stmt } } '}' | NAME ':' stmt | 'throw' expr semi | 'try' block ( catch [ 'finally' block ] | 'finally' block ) | 'debugger' semi | ~'{' ~'function' ~'class' expr semi | function | class | overload | extra ;
overload = [ 'async' ] 'function' [ '*' ] NAME tparams fsig semi ;
interface = 'interface' NAME tparams [ 'extends' heritage { ',' heritage } ] objtype ;
heritage = NAME { '.' WORD } [ targs ] ;
alias = 'type' NAME tparams '=' type semi ;
enum = [ 'const' ] 'enum' NAME '{' [ enumitem { ',' enumitem } [ ',' ] ] '}' ;
enumitem = ( WORD | STR | '[' assign ']' ) [ '=' assign ] ;
namespace = ( 'namespace' | 'module' ) NAME { '.' NAME } block | 'module' STR ( block | semi ) | 'global' block ;
declare = 'declare' ( var semi | overload | [ 'abstract' ] class | interface | alias | enum | namespace ) ;
decorator = '@' ( NAME { '.' WORD } [ targs ] [ '(' [ args ] ')' ] | '(' expr ')' ) ;
binding = ( NAME | bpattern ) [ '!' ] ann [ '=' assign ] ;
ann = [ ':' type ] ;
ret = [ ':' ( type | predicate ) ] ;
predicate = [ 'asserts' ] ( NAME | 'this' ) [ 'is' type ] ;
tparams = [ '<' tparam { ',' tparam } [ ',' ] '>' ] ;
tparam = { 'const' | 'in' | 'out' } NAME [ 'extends' type ] [ '=' type ] ;
targs = '<' type { ',' type } '>' ;
param = { decorator } { modifier } [ '...' ] ( NAME | bpattern | 'this' ) [ '?' ] ann [ '=' assign ] ;
modifier = 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
classtail = tparams [ 'extends' postfix [ targs ] ] [ 'implements' type { ',' type } ] '{' { member } '}' ;
member = ';' | { decorator } { cmod } ( method | methodsig semi | propname [ '?' | '!' ] ann [ '=' assign ] semi | index semi ) | 'static' block ;
cmod = modifier | 'static' | 'abstract' | 'declare' | 'accessor' ;
method = [ 'async' ] [ '*' ] propname [ '?' ] tparams fsig block | ( 'get' | 'set' ) propname fsig block ;
methodsig = [ 'async' ] [ '*' ] propname [ '?' ] tparams fsig | ( 'get' | 'set' ) propname fsig ;
index = '[' NAME ':' type ']' [ '?' ] ann ;
type = conditionaltype ;
conditionaltype = funtype | union [ 'extends' union2 '?' type ':' type ] ;
union2 = union | funtype ;
union = [ '|' | '&' ] postfixtype { ( '|' | '&' ) postfixtype } ;
funtype = [ 'abstract' ] [ 'new' ] tparams '(' [ params ] ')' '=>' ( type | predicate ) ;
postfixtype = { 'keyof' | 'unique' | 'readonly' } primtype { '[' [ type ] ']' } | 'infer' NAME [ 'extends' postfixtype ] ;
primtype = ( NAME | 'void' ) { '.' WORD } [ targs ] | 'this' | 'null' | 'true' | 'false' | STR | [ '-' ] NUM | TEMPLATE | THEAD type { TMIDDLE type } TTAIL | '(' type ')' | objtype | '[' [ tupleitem { ',' tupleitem } [ ',' ] ] ']'
  | 'typeof' ( NAME | 'this' | 'import' '(' STR ')' ) { '.' ( WORD | PRIVATE ) } [ targs ] | 'import' '(' STR ')' { '.' WORD } [ targs ] | mapped ;
tupleitem = [ '...' ] [ WORD [ '?' ] ':' ] [ '...' ] type [ '?' ] ;
objtype = '{' [ typemember { typesep typemember } [ typesep ] ] '}' ;
typesep = ';' | ',' | ASI ;
typemember = { 'readonly' | '+' | '-' } ( propname [ '?' ] ann | propname [ '?' ] tparams fsig | ( 'get' | 'set' ) propname fsig | index ) | [ 'new' ] tparams fsig ;
mapped = '{' [ [ '+' | '-' ] 'readonly' ] '[' NAME 'in' type [ 'as' type ] ']' [ [ '+' | '-' ] '?' ] ann [ ';' | ',' | ASI ] '}' ;
access = '.' ( WORD | PRIVATE ) | '?.' ( WORD | PRIVATE | '[' expr ']' | [ targs ] '(' [ args ] ')' | template ) | '[' expr ']' | '(' [ args ] ')' | template | '!' | targs ;
assign = arrow | unary ASSIGN assign | conditional | yield ;
binary = unary { ( BIN | 'in' | 'instanceof' ) unary | ( 'as' | 'satisfies' ) ( type | 'const' ) } ;
unary = ( 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await' | '++' | '--' ) unary | PRIVATE 'in' unary | '<' ( type | 'const' ) '>' unary | postfix [ '++' | '--' ] ;
newtarget = primary { '.' ( WORD | PRIVATE ) | '[' expr ']' | template } [ targs ] [ '(' [ args ] ')' ] ;
classexpr = [ 'abstract' ] 'class' [ NAME ] classtail ;
for = 'for' [ 'await' ] '(' ( [ var | exprnoin ] ';' [ expr ] ';' [ expr ] | ( ( 'var' | 'let' | 'const' ) ( NAME | bpattern ) ann | unary ) ( 'in' expr | 'of' assign ) ) ')' ;
"""

# fixed values: operators
PYTHON_BIN = ("|", "^", "&", "<<", ">>", "+", "-", "*", "/", "//", "%", "@")
PYTHON_AUG = ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")
C_BIN = ("*", "/", "%", "+", "-", "<<", ">>", "<", ">", "<=", ">=", "==", "!=", "&", "^", "|", "&&", "||")
C_ASSIGN = ("=", "*=", "/=", "%=", "+=", "-=", "<<=", ">>=", "&=", "^=", "|=")
GO_BIN = (*C_BIN, "&^")
GO_ASSIGN = (*C_ASSIGN, "&^=")
JS_ASSIGN = (*C_ASSIGN, "**=", ">>>=", "&&=", "||=", "??=")


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """One grammar per worker and language, so that all files share its derivatives."""
    if language == "Python":
        return Grammar(PYTHON, "file", {"NAME": ("NAME", *PYTHON_SOFT), "BIN": PYTHON_BIN, "AUG": PYTHON_AUG})
    if language == "C":
        return Grammar(C, "unit", {"BIN": C_BIN, "ASSIGN": C_ASSIGN, "UNARY": ("&", "*", "+", "-", "~", "!", "&&"), "ASM": ("asm", "__asm__", "__asm"), "ATTRIBUTE": ("__attribute__",)})
    if language == "Go":
        return Grammar(GO, "file", {"BIN": GO_BIN, "ASSIGN": GO_ASSIGN, "UNARY": ("+", "-", "!", "^", "*", "&", "<-")})
    if language == "Java":
        shifts = ("*", "/", "%", "+", "-", "<<", "<", ">", "<=", ">=", "==", "!=", "&", "^", "|", "&&", "||", ">>", ">>>")
        return Grammar(JAVA, "unit", {"NAME": ("NAME", *JAVA_SOFT), "BIN": shifts, "ASSIGN": (*C_ASSIGN, ">>>=")})
    if language == "Rust":
        leaf = {"NAME", "LIT", "STR", "LIFETIME", *RUST_HARD, *RUST_SOFT, *RUST_OPERATORS, "_"} - {"(", ")", "[", "]", "{", "}"}
        binary = ("*", "/", "%", "+", "-", "<<", "<", "<=", ">=", "==", "!=", "&", "^", "&&", ">", ">>")
        return Grammar(RUST, "file", {"NAME": ("NAME", *RUST_SOFT), "LIT": ("LIT", "STR", "true", "false"), "LEAF": leaf, "BIN": binary, "BINPIPE": ("|", "||"), "ASSIGN": C_ASSIGN})
    words = ("NAME", *JS_SOFT)
    both = {"NAME": words, "WORD": (*words, *JS_HARD), "ASSIGN": JS_ASSIGN, "BIN": ("*", "/", "%", "**", "+", "-", "<<", "<", "<=", ">=", "==", "!=", "===", "!==", "&", "^", "|", "&&", "||", "??", ">", ">>", ">>>")}
    if language == "JavaScript":
        return Grammar(JS, "file", both)
    if language == "TypeScript":
        return Grammar(TYPESCRIPT, "file", both)
    raise ValueError(language)


# fixed values: Rust's punctuation
RUST_OPERATORS = tuple("+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= >>= = == != > < >= <= @ . .. ... ..= , ; : :: -> => # $ ? ~ ( ) [ ] { } >>".split())

