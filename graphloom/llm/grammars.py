"""Grammars of Python 3.13, TypeScript, Rust 2021 and Ruby 3 over the token kinds of the lexers.

AUTO is a semicolon put in by rule where a line ends. They follow the languages' published grammars, widened where a rule needs more than token kinds
(assignment targets, for instance). No rule is left-recursive.
"""

PYTHON = """
file = ( NEWLINE | stmt )* ;
stmt = compound | simple ;
simple = small ( ';' small )* ';'? NEWLINE ;
small = 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' ( expr ( 'from' expr )? )? | 'global' names | 'nonlocal' names
  | 'del' stars | 'assert' expr ( ',' expr )? | import | 'type' NAME tparams? '=' expr | assign ;
names = NAME ( ',' NAME )* ;
import = 'import' dotted as? ( ',' dotted as? )* | 'from' ( '.' | '...' )* fromtail ;
fromtail = dotted 'import' what | 'import' what ;
what = '*' | NAME as? ( ',' NAME as? )* | '(' NAME as? ( ',' NAME as? )* ','? ')' ;
as = 'as' NAME ;
dotted = NAME ( '.' NAME )* ;
assign = stars ( ':' expr ( '=' ( yieldx | stars ) )? | aug ( yieldx | stars ) | ( '=' ( yieldx | stars ) )* ) | yieldx ( '=' ( yieldx | stars ) )* ;
aug = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '**=' | '//=' | '>>=' | '<<=' | '@=' ;
yieldx = 'yield' ( 'from' expr | stars )? ;
stars = star ( ',' star )* ','? ;
star = '*' bor | named ;
named = expr ( ':=' expr )? ;
expr = 'lambda' lparams? ':' expr | or ( 'if' or 'else' expr )? ;
or = and ( 'or' and )* ;
and = not ( 'and' not )* ;
not = 'not' not | cmp ;
cmp = bor ( cop bor )* ;
cop = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? ;
bor = unary ( bop unary )* ;
bop = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' ;
unary = ( '+' | '-' | '~' ) unary | power ;
power = 'await'? atom trailer* ( '**' unary )? ;
trailer = '.' NAME | '(' args? ')' | '[' subs ']' ;
subs = sub ( ',' sub )* ','? ;
sub = named | '*' bor | expr? ':' expr? ( ':' expr? )? ;
args = arg ( ',' arg )* ','? ;
arg = named comp? | NAME '=' expr | '*' expr | '**' expr ;
comp = ( 'async'? 'for' targets 'in' or compif* )+ ;
compif = 'if' orif ;
orif = 'lambda' lparams? ':' orif | named2 ;
named2 = or ( ':=' or )? ;
targets = target ( ',' target )* ','? ;
target = '*'? bor ;
atom = NAME | NUMBER | str+ | 'None' | 'True' | 'False' | '...' | '(' ( yieldx | star comp? ( ',' star )* ','? )? ')'
  | '[' ( star comp? ( ',' star )* ','? )? ']' | '{' ( dictset )? '}' ;
str = STRING | FSTRING | BYTES ;
dictset = pair comp | pair ( ',' pair )* ','? | star comp | star ( ',' star )* ','? ;
pair = expr ':' expr | '**' bor ;
lparams = lparam ( ',' lparam )* ','? ;
lparam = NAME ( '=' expr )? | '*' NAME? | '**' NAME | '/' ;
compound = 'async'? funcdef | ifstmt | whilestmt | 'async'? forstmt | trystmt | 'async'? withstmt | classdef | '@' named NEWLINE decorated | matchstmt ;
decorated = '@' named NEWLINE decorated | 'async'? funcdef | classdef ;
block = simple | NEWLINE INDENT stmt+ DEDENT ;
funcdef = 'def' NAME tparams? '(' params? ')' ( '->' expr )? ':' block ;
params = param ( ',' param )* ','? ;
param = NAME ( ':' expr )? ( '=' expr )? | '*' ( NAME ( ':' ( expr | '*' bor ) )? )? | '**' NAME ( ':' expr )? | '/' ;
tparams = '[' tparam ( ',' tparam )* ','? ']' ;
tparam = ( '*' | '**' )? NAME ( ':' expr )? ( '=' ( expr | '*' bor ) )? ;
ifstmt = 'if' named ':' block ( 'elif' named ':' block )* ( 'else' ':' block )? ;
whilestmt = 'while' named ':' block ( 'else' ':' block )? ;
forstmt = 'for' targets 'in' stars ':' block ( 'else' ':' block )? ;
trystmt = 'try' ':' block ( ( 'except' ( '*'? expr ( 'as' NAME )? )? ':' block )+ ( 'else' ':' block )? ( 'finally' ':' block )? | 'finally' ':' block ) ;
withstmt = 'with' ( withitem ( ',' withitem )* | '(' withitem ( ',' withitem )* ','? ')' ) ':' block ;
withitem = expr ( 'as' bor )? ;
classdef = 'class' NAME tparams? ( '(' args? ')' )? ':' block ;
matchstmt = 'match' stars ':' NEWLINE INDENT caseblock+ DEDENT ;
caseblock = 'case' patterns ( 'if' named )? ':' block ;
patterns = pattern ( ',' pattern )* ','? ;
pattern = '*' NAME | orpat ( 'as' NAME )? ;
orpat = patom ( '|' patom )* ;
patom = '-'? NUMBER ( ( '+' | '-' ) NUMBER )? | str+ | 'None' | 'True' | 'False' | NAME ( '.' NAME )* ( '(' ( parg ( ',' parg )* ','? )? ')' )?
  | '(' patterns? ')' | '[' patterns? ']' | '{' ( ppair ( ',' ppair )* ','? )? '}' ;
parg = pattern | NAME '=' pattern ;
ppair = '**' NAME | patom ':' pattern ;
"""

#: Names of TypeScript by context: plain names, and words that are keywords only in some places.
_TS_SOFT = "abstract accessor any as asserts async await bigint boolean constructor declare from get global implements infer interface is keyof let module namespace never number object of out override package private protected public readonly require satisfies set static string symbol type undefined unique unknown using yield"
_TS_HARD = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"


def _any_of(words: str) -> str:
    return " | ".join(f"'{w}'" for w in words.split())


TYPESCRIPT = f"""
file = stmt* ;
semi = ';' | AUTO ;
id = NAME | {_any_of(_TS_SOFT)} ;
word = id | {_any_of(_TS_HARD)} ;
stmt = ';' | block | decl | 'if' '(' seq ')' stmt ( 'else' stmt )? | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' seq ')' stmt
  | 'do' stmt 'while' '(' seq ')' semi? | 'return' seq? semi | 'throw' seq semi | 'break' id? semi | 'continue' id? semi | 'debugger' semi
  | 'switch' '(' seq ')' '{{' ( ( 'case' seq | 'default' ) ':' stmt* )* '}}' | 'try' block ( 'catch' ( '(' bind ( ':' type )? ')' )? block )? ( 'finally' block )?
  | id ':' stmt | import | export | seq semi ;
block = '{{' stmt* '}}' ;
forhead = ( varkw binding ( ',' binding )* | seq )? ';' seq? ';' seq? | ( varkw bind ( ':' type )? | postfix ) ( 'of' | 'in' ) seq ;
varkw = 'var' | 'let' | 'const' | 'using' | 'await' 'using' ;
decl = varkw binding ( ',' binding )* semi | 'async'? function | decorator* 'abstract'? class | 'const'? enum | interface | alias | ( 'namespace' | 'module' | 'global' ) modname? block
  | 'declare' decl | function1 semi ;
modname = id ( '.' id )* | STRING ;
binding = bind '!'? ( ':' type )? ( '=' assign )? ;
bind = id | '{{' ( bprop ( ',' bprop )* ','? )? '}}' | '[' ( bel? ( ',' bel? )* ) ']' ;
bprop = '...' bind | id ( '=' assign )? | key ':' bind ( '=' assign )? ;
bel = '...'? bind ( '=' assign )? ;
function = 'function' '*'? id? tparams? '(' params? ')' ( ':' rettype )? block ;
function1 = 'async'? 'function' '*'? id tparams? '(' params? ')' ( ':' rettype )? ;
params = param ( ',' param )* ','? ;
param = decorator* ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )* '...'? ( bind | 'this' ) '?'? ( ':' type )? ( '=' assign )? ;
rettype = type | 'asserts' ( id | 'this' ) ( 'is' type )? | ( id | 'this' ) 'is' type ;
decorator = '@' ( '(' seq ')' | id ( '.' ( word | PRIVATE ) )* targs? ( '(' args? ')' )? ) ;
class = 'class' id? tparams? ( 'extends' postfix targs? )? ( 'implements' typeref ( ',' typeref )* )? '{{' member* '}}' ;
modifier = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'readonly' | 'override' | 'async' | 'declare' | 'accessor' | 'get' | 'set' ;
member = ';' | 'static' block | decorator* modifier* ( '*'? key ( '?' | '!' )? ( method | ( ':' type )? ( '=' assign )? semi ) | index semi ) ;
method = tparams? '(' params? ')' ( ':' rettype )? ( block | semi ) ;
index = '[' id ':' type ']' ':' type ;
key = word | PRIVATE | STRING | NUMBER | '[' assign ']' ;
enum = 'enum' id '{{' ( key ( '=' assign )? ( ',' key ( '=' assign )? )* ','? )? '}}' ;
interface = 'interface' id tparams? ( 'extends' typeref ( ',' typeref )* )? objtype ;
alias = 'type' id tparams? '=' type semi ;
import = 'import' ( STRING | 'type'? importwhat 'from' STRING | 'type'? id '=' ( 'require' '(' STRING ')' | id ( '.' id )* ) ) ( 'with' '{{' ( key ':' STRING ( ',' key ':' STRING )* ','? )? '}}' )? semi ;
importwhat = id ( ',' ( '*' 'as' id | specs ) )? | '*' 'as' id | specs ;
specs = '{{' ( spec ( ',' spec )* ','? )? '}}' ;
spec = 'type'? ( word | STRING ) ( 'as' ( word | STRING ) )? ;
export = 'export' ( decl | 'default' ( 'async'? function | decorator* 'abstract'? class | interface | assign semi ) | 'type'? '*' ( 'as' ( word | STRING ) )? 'from' STRING semi | 'type'? specs ( 'from' STRING )? semi | '=' seq semi | 'as' 'namespace' id semi | import )
  | decorator+ 'export' 'default'? 'abstract'? class ;
seq = assign ( ',' assign )* ;
assign = arrow | 'yield' '*'? assign | cond ( aop assign )? ;
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
arrow = 'async'? ( id | tparams? '(' params? ')' ( ':' rettype )? ) '=>' ( block | assign ) ;
cond = bin ( '?' assign ':' assign )? ;
bin = unary ( binop unary | ( 'as' | 'satisfies' ) ( type | 'const' ) )* ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | '&&' | '||' | '??' | 'instanceof' | 'in' ;
unary = ( '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ) unary | '<' ( type | 'const' ) '>' unary | postfix ( '++' | '--' )? ;
postfix = primary tail* ;
tail = '.' ( word | PRIVATE ) | '?.' ( word | PRIVATE | '[' seq ']' | targs? '(' args? ')' | TEMPLATE ) | '[' seq ']' | '(' args? ')' | '!' | TEMPLATE | targs ;
args = arg ( ',' arg )* ','? ;
arg = '...'? assign ;
primary = id | NUMBER | STRING | TEMPLATE | REGEX | PRIVATE | 'this' | 'super' | 'null' | 'true' | 'false' | '(' seq ')' | '[' ( aitem? ( ',' aitem? )* ) ']' | '{{' ( prop ( ',' prop )* ','? )? '}}'
  | 'async'? function | decorator* class | 'new' ( '.' id | newtarget ) | 'import' ( '(' args ')' | '.' id ) ;
newtarget = 'new' newtarget | primary ( '.' ( word | PRIVATE ) | '[' seq ']' )* targs? ( '(' args? ')' )? ;
aitem = '...'? assign ;
prop = '...' assign | id ( '=' assign )? | key ':' assign | ( 'async' | 'get' | 'set' )? '*'? key tparams? '(' params? ')' ( ':' rettype )? block ;
tparams = '<' tparam ( ',' tparam )* ','? '>' ;
tparam = ( 'const' | 'in' | 'out' )* id ( 'extends' type )? ( '=' type )? ;
targs = '<' type ( ',' type )* '>' ;
type = fntype | utype ( 'extends' type '?' type ':' type )? ;
fntype = 'abstract'? 'new'? tparams? '(' params? ')' '=>' rettype ;
utype = '|'? itype ( '|' itype )* ;
itype = '&'? ptype ( '&' ptype )* ;
ptype = ( 'keyof' | 'unique' | 'readonly' ) ptype | 'infer' id ( 'extends' utype )? | atype ( '[' type? ']' )* ;
atype = typeref | 'typeof' ( id | 'this' | 'import' '(' STRING ')' ) ( '.' ( word | PRIVATE ) )* targs? | 'this' | 'void' | 'null' | 'true' | 'false' | STRING | '-'? NUMBER | TEMPLATE | '(' type ')'
  | '[' ( titem ( ',' titem )* ','? )? ']' | objtype | 'import' '(' STRING ')' ( '.' id )* targs? | 'asserts' id ;
titem = '...'? ( id '?'? ':' )? '...'? type '?'? ;
typeref = id ( '.' word )* targs? ;
objtype = '{{' ( tmember ( ( semi | ',' ) tmember )* ( semi | ',' )? )? '}}' ;
tmember = ( 'readonly' | 'get' | 'set' )* key '?'? ( ':' type )? | ( 'get' | 'set' )? key '?'? tparams? '(' params? ')' ( ':' rettype )? | 'new'? tparams? '(' params? ')' ( ':' rettype )? | 'readonly'? '[' id ':' type ']' ':' type
  | ( ( '+' | '-' )? 'readonly' )? '[' id 'in' type ( 'as' type )? ']' ( ( '+' | '-' )? '?' )? ( ':' type )? ;
"""

RUST = """
file = ( '#' '!' '[' tokens ']' )* item* ;
attr = '#' '[' tokens ']' ;
inner = '#' '!' '[' tokens ']' ;
tokens = tree* ;
tree = '(' tokens ')' | '[' tokens ']' | '{' tokens '}' | any ;
any = NAME | 'union' | '_' | NUMBER | STRING | CHAR | LIFETIME | keyword | mark ;
keyword = 'as' | 'async' | 'await' | 'break' | 'const' | 'continue' | 'crate' | 'dyn' | 'else' | 'enum' | 'extern' | 'false' | 'fn' | 'for' | 'if' | 'impl' | 'in' | 'let' | 'loop' | 'match' | 'mod' | 'move' | 'mut' | 'pub' | 'ref' | 'return' | 'self' | 'Self'
  | 'static' | 'struct' | 'super' | 'trait' | 'true' | 'type' | 'unsafe' | 'use' | 'where' | 'while' ;
mark = '+' | '-' | '*' | '/' | '%' | '^' | '!' | '&' | '|' | '&&' | '||' | '<<' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '=' | '==' | '!=' | '>' | '<' | '>=' | '<=' | '@' | '.' | '..' | '...' | '..=' | ',' | ';' | ':' | '::' | '->' | '=>' | '#' | '$' | '?' | '~' ;
vis = 'pub' ( '(' ( 'crate' | 'self' | 'super' | 'in' path ) ')' )? ;
item = attr* ( vis? plain | macroitem ) ;
plain = 'use' usetree ';' | 'mod' NAME ( ';' | '{' inner* item* '}' ) | 'unsafe'? 'extern' ( 'crate' ( NAME | 'self' ) ( 'as' ( NAME | '_' ) )? ';' | STRING? '{' inner* item* '}' ) | fn | struct | enum | union | trait | impl
  | 'type' NAME generics? ( ':' bounds? )? where? ( '=' type where? )? ';' | 'const' ( NAME | '_' ) ( ':' type )? ( '=' expr )? ';' | 'static' 'mut'? NAME ':' type ( '=' expr )? ';' ;
macroitem = path '!' NAME? ( '{' tokens '}' | ( '(' tokens ')' | '[' tokens ']' ) ';' ) ;
usetree = ( '::'? pathseg ( '::' pathseg )* ( 'as' ( NAME | '_' ) | '::' usegroup )? ) | '::'? usegroup ;
usegroup = '*' | '{' ( usetree ( ',' usetree )* ','? )? '}' ;
pathseg = NAME | 'self' | 'super' | 'crate' | 'Self' | '$' 'crate' ;
path = '::'? pathseg ( '::' pathseg )* ;
fnquals = 'const'? 'async'? 'unsafe'? ( 'extern' STRING? )? ;
fn = fnquals 'fn' NAME generics? '(' fnparams? ')' ( '->' type )? where? ( block | ';' ) ;
fnparams = fnparam ( ',' fnparam )* ','? ;
fnparam = attr* ( selfparam | pattern ':' ( type | '...' ) | '...' | type ) ;
selfparam = ( '&' LIFETIME? )? 'mut'? 'self' ( ':' type )? ;
generics = '<' ( gparam ( ',' gparam )* ','? )? '>' ;
gparam = attr* ( LIFETIME ( ':' lbounds? )? | NAME ( ':' bounds? )? ( '=' type )? | 'const' NAME ':' type ( '=' constarg )? ) ;
constarg = block | '-'? lit | NAME ;
lbounds = LIFETIME ( '+' LIFETIME )* '+'? ;
bounds = bound ( '+' bound )* '+'? ;
bound = LIFETIME | '(' bound1 ')' | bound1 ;
bound1 = ( '?' | '~' 'const' )? ( 'for' generics )? tpath ;
where = 'where' ( wherepred ( ',' wherepred )* ','? )? ;
wherepred = LIFETIME ':' lbounds? | ( 'for' generics )? type ':' bounds? ;
struct = 'struct' NAME generics? ( where? ( '{' fields? '}' | ';' ) | '(' tfields? ')' where? ';' ) ;
union = 'union' NAME generics? where? '{' fields? '}' ;
fields = field ( ',' field )* ','? ;
field = attr* vis? NAME ':' type ;
tfields = tfield ( ',' tfield )* ','? ;
tfield = attr* vis? type ;
enum = 'enum' NAME generics? where? '{' ( variant ( ',' variant )* ','? )? '}' ;
variant = attr* vis? NAME ( '{' fields? '}' | '(' tfields? ')' )? ( '=' expr )? ;
trait = 'unsafe'? 'trait' NAME generics? ( ':' bounds? )? where? '{' inner* item* '}' ;
impl = 'unsafe'? 'impl' generics? 'const'? '!'? type ( 'for' type )? where? '{' inner* item* '}' ;
type = notype ( '+' bound )* ;
notype = '(' ( type ( ',' type )* ','? )? ')' | '!' | ( '&' | '&&' ) LIFETIME? 'mut'? notype | '*' ( 'const' | 'mut' ) notype | '[' type ( ';' expr )? ']' | '_' | ( 'dyn' | 'impl' ) bounds | ( 'for' generics )? ( fntype | tpath ) ( '!' delim )? ;
fntype = 'unsafe'? ( 'extern' STRING? )? 'fn' '(' ( fnargt ( ',' fnargt )* ','? )? ')' ( '->' notype )? ;
fnargt = attr* ( ( NAME | '_' ) ':' )? ( type | '...' ) ;
tpath = qself? '::'? tseg ( '::' tseg )* ;
qself = ( '<' | '<<' ) type ( 'as' tpath )? '>' '::' ;
tseg = pathseg ( '::'? gargs | '(' ( type ( ',' type )* ','? )? ')' ( '->' notype )? )? ;
gargs = '<' ( garg ( ',' garg )* ','? )? '>' ;
garg = LIFETIME | type | block | '-'? lit | NAME gargs? '=' type | NAME gargs? ':' bounds ;
delim = '(' tokens ')' | '[' tokens ']' | '{' tokens '}' ;
pattern = '|'? pat ( '|' pat )* ;
pat = '_' | '..' | ( '&' | '&&' ) 'mut'? pat | 'ref'? 'mut'? NAME ( '@' pat )? | '(' ( pattern ( ',' pattern )* ','? )? ')' | '[' ( pattern ( ',' pattern )* ','? )? ']'
  | patbound ( ( '..=' | '...' | '..' ) patbound? )? | ( '..=' | '..' ) patbound | epath ( '(' ( pattern ( ',' pattern )* ','? )? ')' | '{' ( fpat ( ',' fpat )* ','? )? '}' | '!' delim )? | 'const' block ;
patbound = '-'? lit | epath ;
fpat = attr* ( ( NAME | NUMBER ) ':' pattern | 'ref'? 'mut'? NAME | '..' ) ;
lit = NUMBER | STRING | CHAR | 'true' | 'false' ;
block = '{' inner* stmt* expr0? '}' ;
expr0 = attr* expr ;
stmt = ';' | item | attr* 'let' pattern ( ':' type )? ( '=' expr ( 'else' block )? )? ';' | attr* blocklike | attr* expr ';' | attr* path '!' '{' tokens '}' ;
blocklike = ( LIFETIME ':' )? ( 'unsafe' block | 'async' 'move'? block | 'const' block | block | if | match | 'while' expr block | 'loop' block | 'for' pattern 'in' expr block ) ;
if = 'if' expr block ( 'else' ( if | block ) )? ;
match = 'match' expr '{' inner* ( arm )* '}' ;
arm = attr* pattern ( 'if' expr )? '=>' ( blocklike ','? | expr ',' | expr ) ;
expr = assign ;
assign = range ( aop assign )? ;
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>=' ;
range = bin ( ( '..' | '..=' ) bin? )? | ( '..' | '..=' ) bin? ;
bin = unary ( binop unary | 'as' notype )* ;
binop = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '<<' | '>' '>' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' ;
unary = ( '-' | '!' | '*' | ( '&' | '&&' ) 'mut'? | '&' NAME ( 'const' | 'mut' ) ) unary | 'let' pattern '=' unary | closure | jump | postfix ;
closure = 'static'? 'async'? 'move'? ( '||' | '|' ( cparam ( ',' cparam )* ','? )? '|' ) ( '->' notype block | expr ) ;
cparam = attr* pat ( ':' type )? ;
jump = 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? ;
postfix = primary ( '?' | '.' ( 'await' | NAME ( '::' gargs )? | NUMBER ) | '(' args? ')' | '[' expr ']' )* ;
args = attr* expr ( ',' attr* expr )* ','? ;
primary = lit | epath ( '!' delim | '{' sfields? '}' )? | '(' ( args )? ')' | '[' ( expr ( ';' expr | ( ',' attr* expr )* ','? ) )? ']' | blocklike ;
epath = qself? '::'? eseg ( '::' eseg )* ;
eseg = pathseg ( '::' gargs )? ;
sfields = sfield ( ',' sfield )* ','? ;
sfield = attr* ( ( NAME | NUMBER ) ( ':' expr )? | '..' expr? ) ;
"""

RUBY = """
file = stmts ;
stmts = t* ( stmt ( t+ stmt )* )? t* ;
t = NL | ';' ;
n = NL* ;
stmt = head ( 'if_mod' n head | 'unless_mod' n head | 'while_mod' n head | 'until_mod' n head | 'rescue_mod' n head )* ;
head = notx ( ( 'and' | 'or' ) n notx )* | 'alias' n any2 any2 | 'undef' any2 ( ',' n any2 )* | 'BEGIN' '{' stmts '}' | 'END' '{' stmts '}' | masgn ;
any2 = NAME | CONST | FNAME | SYMBOL | VAR | op2 ;
op2 = '+' | '-' | '*' | '/' | '==' | '<' | '>' | '<<' | '[' ']' ;
masgn = ( mlhs ',' )+ ( '=' n rhs | mlhs '=' n rhs | ( '*' | 'U*' ) mlhs? ( ',' mlhs )* '=' n rhs ) | ( '*' | 'U*' ) mlhs ( ',' mlhs )* '=' n rhs ;
mlhs = post | '(' mlhs ( ',' mlhs )* ')' | ( '*' | 'U*' ) post ;
rhs = arg ( ',' n arg )* ;
notx = 'not' notx | expr ;
expr = tern ( asop n ( 'rescue_mod' )? assignrhs )? ( ( 'in' | '=>' ) pattern )? ;
assignrhs = expr ( ',' n splatarg )* ( 'rescue_mod' n expr )? | ( '*' | 'U*' ) expr ( ',' n splatarg )* ;
splatarg = ( '*' | 'U*' )? expr ;
asop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&&=' | '||=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
tern = range ( '?' n expr n ( ':' n expr | LABELX expr ) | '?' n LABEL n expr )? ;
range = bin ( ( '..' | '...' ) bin? )? | ( '..' | '...' ) bin ;
bin = un ( binop n un )* ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '<<' | '>>' | '&&' | '||' | '==' | '!=' | '===' | '=~' | '!~' | '<=>' | '<' | '>' | '<=' | '>=' ;
un = ( '-' | '!' | '+' | '~' | 'U-' | 'U+' | '&' | 'defined?' ) n un | 'defined?' 'CALL' n expr n ')' tail* | post ;
post = prim tail* ;
tail = ( '.' | '&.' ) n ( fcall | ( 'CALL' | '(' ) n ( args n )? ')' block? ) | '::' n ( fcall | CONST callargs? block? ) | IDX n ( args )? n ']' block? ;
fcall = ( FNAME | NAME | CONST ) ( callargs | cmdargs )? block? ;
CALL1X = NAME ;
callargs = 'CALL' n ( args n )? ')' ;
cmdargs = arg1 ( ',' n arg )* ;
block = 'BLOCK' bparams? stmts '}' | 'do' bparams? body 'end' ;
bparams = '|' n ( bparam ( ',' n bparam )* ','? )? n ( ';' NAME ( ',' NAME )* )? '|' | '||' ;
bparam = ( '*' | 'U*' | '**' | 'U**' | '&' | 'U&' )? NAME ( '=' bin0 )? | '*' | 'U*' | '**' | 'U**' | '&' | 'U&' | LABEL bin0? | '(' bparam ( ',' bparam )* ')' ;
bin0 = un ( binop0 n un )* ;
binop0 = '+' | '-' | '*' | '/' | '%' | '**' | '&&' | '||' | '==' ;
args = arg ( ',' n arg )* ','? ;
arg = ( '*' | 'U*' | '**' | 'U**' | '&' | 'U&' )? argx | '*' | '**' | '&' | 'U*' | 'U**' | 'U&' | '...' ;
arg1 = ( 'U*' | 'U**' | 'U&' ) argx | argx1 ;
argx = LABEL n ( nexpr )? | nexpr ( '=>' n nexpr )? ;
argx1 = LABEL n ( nexpr )? | nexpr1 ( '=>' n nexpr )? ;
nexpr = 'not' nexpr | tern ( asop n assignrhs1 )? ;
nexpr1 = tern ( asop n assignrhs1 )? ;
assignrhs1 = nexpr ;
prim = NAME ( callargs | cmdargs )? block? | CONST ( callargs | cmdstr )? block? | 'super' ( callargs | cmdargs )? block? | 'yield' ( callargs | cmdargs )? | NUMBER | STRING+ | SYMBOL | REGEX | CHAR | VAR | 'nil' | 'true' | 'false' | 'self' | '__FILE__' | '__LINE__' | '__ENCODING__' | 'redo' | 'retry'
  | ( 'return' | 'break' | 'next' ) ( rhs )? | '(' stmts ')' | '[' n ( args n )? ']' | '{' n ( pairs n )? '}' | '::' CONST | 'U::' CONST | '->' lparams? lbody
  | 'if' head then stmts ( 'elsif' head then stmts )* ( 'else' stmts )? 'end' | 'unless' head then stmts ( 'else' stmts )? 'end' | ( 'while' | 'until' ) head dosep stmts 'end'
  | 'for' mlhs ( ',' mlhs )* 'in' head dosep stmts 'end' | 'case' head? n whens ( 'else' stmts )? 'end' | 'case' head n ins ( 'else' stmts )? 'end' | 'begin' body 'end' | def
  | 'class' ( cpath ( '<' expr )? t | '<<' expr t ) body 'end' | 'module' cpath t? body 'end' ;
cmdstr = ( STRING | CONST | SYMBOL ) ( ',' n arg )* ;
cpath = '::'? CONST ( '::' CONST )* ;
then = t+ 'then'? | 'then' | t+ ;
dosep = t+ | 'do' ;
whens = ( 'when' n arg ( ',' n arg )* then stmts )+ ;
ins = ( 'in' pattern ( ( 'if_mod' | 'unless_mod' | 'if' | 'unless' ) head )? then stmts )+ ;
pattern = pat1 ( ',' n pat1 )* ','? ;
pat1 = patv ( '|' n patv )* ( '=>' NAME )? ;
patv = ( '*' | 'U*' ) NAME? | ( '**' | 'U**' ) ( NAME | 'nil' ) | LABEL ( pat1 )? | '^' ( NAME | VAR | '(' expr ')' ) | NAME | CONST ( '::' CONST )* ( 'CALL' n ( pattern n )? ')' | IDX n ( pattern n )? ']' )? | '[' n ( pattern n )? ']' | '{' n ( pattern n )? '}' | patlit ( ( '..' | '...' ) patlit? )? | ( '..' | '...' ) patlit ;
patlit = ( '-' | 'U-' )? NUMBER | STRING+ | SYMBOL | REGEX | 'nil' | 'true' | 'false' | CHAR | 'self' ;
body = stmts ( 'rescue' ( rarg ( ',' n rarg )* )? ( '=>' post )? ( then | t* ) stmts )* ( 'else' stmts )? ( 'ensure' stmts )? ;
rarg = ( '*' | 'U*' )? tern ;
def = 'def' ( 'self' '.' | VAR '.' | ( NAME | CONST | FNAME ) '.' )? ( FNAME | NAME | CONST | 'self' ) ( ( 'CALL' | '(' ) n ( params n )? ')' ( t | EQ1 )? defbody | params1? t body 'end' | '=' n stmt | t body 'end' ) ;
defbody = body 'end' | '=' n stmt ;
params = param ( ',' n param )* ','? ;
params1 = param ( ',' n param )* ;
param = ( '*' | 'U*' | '**' | 'U**' | '&' | 'U&' )? NAME ( '=' n tern )? | '*' | 'U*' | '**' | 'U**' | '&' | 'U&' | LABEL tern? | '...' | ( '**' | 'U**' ) 'nil' | '(' param ( ',' param )* ')' ;
lparams = ( '(' | 'CALL' ) n ( params n )? ')' | params1 ;
lbody = ( '{' | 'BLOCK' ) stmts '}' | 'do' body 'end' ;
pairs = pair ( ',' n pair )* ','? ;
pair = LABEL n ( nexpr )? | nexpr n '=>' n nexpr | ( '**' | 'U**' ) nexpr ;
"""
