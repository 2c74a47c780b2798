"""Grammars of the languages, as text for ``chart.Grammar``. Fixed values from the languages' public definitions."""

import re

JSON = """
text = value EOF ;
value = object | array | STR | NUM | 'true' | 'false' | 'null' ;
object = '{' ( member % ',' )? '}' ;
member = STR ':' value ;
array = '[' ( value % ',' )? ']' ;
"""

#: ECMAScript modules; the parts in double braces are TypeScript's. Rules with an @ are written twice, with RETURN inside
#: of functions and, as ``_top``, without it.
_SCRIPT = """
CONTEXTUAL := 'as' 'from' 'of' 'get' 'set' 'async' 'accessor' 'type' 'namespace' 'module' 'declare' 'abstract' 'readonly' 'is' 'keyof' 'infer'
  'unique' 'asserts' 'satisfies' 'override' 'out' 'require' 'global' 'target' 'meta' 'using' 'defer' 'source' ;
STRICT := 'let' 'static' 'implements' 'interface' 'package' 'private' 'protected' 'public' ;
RESERVED := 'break' 'case' 'catch' 'class' 'const' 'continue' 'debugger' 'default' 'delete' 'do' 'else' 'enum' 'export' 'extends' 'false'
  'finally' 'for' 'function' 'if' 'import' 'in' 'instanceof' 'new' 'null' 'return' 'super' 'switch' 'this' 'throw' 'true' 'try' 'typeof'
  'var' 'void' 'while' 'with' 'await' 'yield' ;
NAME := ID CONTEXTUAL ;
WORD := NAME STRICT RESERVED ;
ASSIGN := '=' '+=' '-=' '*=' '/=' '%=' '**=' '<<=' '>>=' '>>>=' '&=' '|=' '^=' '&&=' '||=' '??=' ;
BINARY := '+' '-' '*' '/' '%' '<' '<=' '>=' '==' '!=' '===' '!==' '&' '|' '^' '<<' 'in' 'instanceof' ;
PREFIX := 'delete' 'void' 'typeof' '+' '-' '~' '!' 'await' ;
CONSTANT := 'this' 'super' 'true' 'false' 'null' ;
PLACE := WORD PRIVATE ']' {{ '!' }} ;
MODIFIER := 'static' 'accessor' {{ 'public' 'private' 'protected' 'readonly' 'abstract' 'override' 'declare' }} ;

program = moditem** EOF ;
moditem = importdecl | exportdecl | stmt_top ;
eos = ';' | &'}' | &EOF | NL ;
withclause = 'with' object ;
importdecl = 'import' STR withclause? eos
  | 'import' importclause 'from' STR withclause? eos
  {{ | 'import' 'type' importclause 'from' STR withclause? eos
  | 'import' 'type'? NAME '=' ( 'require' '(' STR ')' | qname ) eos }} ;
importclause = starimport | namedimports | NAME ( ',' ( starimport | namedimports ) )? ;
starimport = '*' 'as' NAME ;
namedimports = '{' ( importspec % ',' ','? )? '}' ;
importspec = {{ 'type' exportname 'as' NAME | 'type' !'as' exportname | }} exportname 'as' NAME | NAME ;
exportname = WORD | STR ;
exportdecl = 'export' ( '*' ( 'as' exportname )? 'from' STR withclause? eos
  | exportlist ( 'from' STR withclause? )? eos
  {{ | 'type' exportlist ( 'from' STR )? eos | 'type' '*' ( 'as' exportname )? 'from' STR eos | '=' expr eos | 'as' 'namespace' NAME eos
  | 'import' 'type'? NAME '=' ( 'require' '(' STR ')' | qname ) eos | 'default' interfacedecl | 'default' 'abstract' classdecl }}
  | 'default' ( functiondecl | classdecl | unnamed | assign eos )
  | declaration )
  | decorator+ 'export' ( classdecl | 'default' ( classdecl | unnamed ) ) ;
exportlist = '{' ( exportspec % ',' ','? )? '}' ;
exportspec = {{ 'type' !'as' exportname ( 'as' exportname )? | }} exportname ( 'as' exportname )? ;
declaration = functiondecl | classdecl | vardecl eos {{ | tsdecl }} ;

stmt@ = functiondecl | classdecl | lexical eos | {{ tsdecl | }} body@ ;
body@ = block@ | 'var' ( vardef % ',' ) eos | ';' | ifstmt@ | forstmt@ | 'while' '(' expr ')' body@ | 'do' body@ 'while' '(' expr ')' ';'?
  | 'continue' ( NONL NAME )? eos | 'break' ( NONL NAME )? eos | RETURN@ 'throw' NONL expr eos
  | switchstmt@ | trystmt@ | 'debugger' eos | NAME ':' body@ | exprstmt ;
block@ = '{' stmt@* '}' ;
ifstmt@ = 'if' '(' expr ')' body@ ( 'else' body@ )? ;
forstmt@ = 'for' 'await'? '(' ( ( 'var' | 'let' | 'const' | 'await'? 'using' ) target {{ annotation? }} ( 'of' assign | 'in' expr ) ')'
  | place ( 'of' assign | 'in' expr ) ')'
  | ( vardecl | expr )? ';' expr? ';' expr? ')' ) body@ ;
switchstmt@ = 'switch' '(' expr ')' '{' ( ( 'case' expr | 'default' ) ':' stmt@* )* '}' ;
trystmt@ = 'try' block@ ( 'catch' ( '(' target {{ annotation? }} ')' )? block@ ( 'finally' block@ )? | 'finally' block@ ) ;
exprstmt = !( '{' | 'function' | 'class' ) expr eos ;
lexical = 'let' ( vardef % ',' ) | 'const' ( constdef % ',' ) | 'await'? 'using' NONL ( constdef % ',' ) ;
vardecl = 'var' ( vardef % ',' ) | lexical ;
vardef = NAME {{ '!'? annotation? }} ( '=' assign )? | pattern {{ annotation? }} '=' assign ;
constdef = target {{ annotation? }} '=' assign {{ | NAME annotation }} ;
target = NAME | pattern ;
pattern = '{' ( ( patternprop % ',' ( ',' restprop )? ','? ) | restprop )? '}' | '[' ','* ( patternelem ( ','+ patternelem )* ','* )? ']' ;
restprop = '...' NAME ;
patternprop = propname ':' target ( '=' assign )? | NAME ( '=' assign )? ;
patternelem = '...' target | target ( '=' assign )? ;

functiondecl = ( 'async' NONL )? 'function' '*'? NAME signature ( block {{ | eos }} ) ;
unnamed = ( 'async' NONL )? 'function' '*'? signature ( block {{ | eos }} ) | decorator* {{ 'abstract'? }} 'class' classtail ;
signature = {{ typeparams? }} '(' params? ')' {{ annotation? }} ;
params = param ( ',' param )* ','? ;
param = {{ decorator* ( MODIFIER &( MODIFIER | NAME | '{' | '[' ) )* }} ( '...' target {{ annotation? }} | {{ 'this' annotation | }} target {{ '?'? annotation? }} ( '=' assign )? ) ;
decorator = '@' ( '(' expr ')' | NAME ( '.' WORD )* {{ typeargs? }} args? ) ;
classdecl = decorator* {{ 'abstract'? }} 'class' NAME classtail ;
classtail = {{ typeparams? }} ( 'extends' call {{ typeargs? }} )? {{ ( 'implements' ( type % ',' ) )? }} '{' member* '}' ;
member = ';' | 'static' block | decorator* ( MODIFIER !( '(' | '=' | ';' | '}' | ',' {{ | ':' | '?' | '!' | '<' }} ) )* memberbody ;
memberbody = {{ indexsignature eos | }} ( 'get' | 'set' ) propname signature ( block {{ | eos }} )
  | ( 'async' NONL )? '*'? propname {{ '?'? }} signature ( block {{ | eos }} )
  | propname {{ ( '?' | '!' )? annotation? }} ( '=' assign )? eos ;
propname = WORD | STR | NUM | PRIVATE | '[' assign ']' ;

expr = assign % ',' ;
assign = arrow | 'yield' ( NONL '*'? assign )? | places '=' assign | !( ( array | object ) ASSIGN ) simple ASSIGN assign | conditional ;
simple = enclosed | !( CONSTANT ASSIGN ) call ^PLACE ;
enclosed = '(' ( {{ '<' type '>' simple | }} simple {{ ( NONL ( 'as' | 'satisfies' ) ( 'const' | type ) )* }} ) ')' !( '.' | '[' | '(' | '?.' | TEMPLATE | HEAD ) ;
place = places &( 'of' | 'in' | '=' | ',' | ']' | '}' ) | simple ;
places = '{' ( ( placeprop % ',' ( ',' '...' place )? ','? ) | '...' place )? '}' | '[' ','* ( placeelem ( ','+ placeelem )* ','* )? ']' ;
placeprop = propname ':' place ( '=' assign )? | NAME ( '=' assign )? ;
placeelem = '...' place | place ( '=' assign )? ;
arrow = ( 'async' NONL )? ( NAME | signature ) NONL '=>' ( block | !'{' assign ) ;
conditional = binary ( '?' assign ':' assign )? ;
binary = bitwise ( ( '??' bitwise )+ !( '||' | '&&' ) | ( ( '||' | '&&' ) bitwise )+ !'??' )? ;
bitwise = unary ( ( BINARY | shift ) unary {{ | NONL ( 'as' | 'satisfies' ) ( 'const' | type ) }} )* ;
shift = '>' ( '>' '>'? )? ;
unary = PREFIX operand !'**' {{ | '<' ( 'const' | type ) '>' unary }} | PRIVATE &'in' | update ( '**' unary )? ;
operand = PREFIX operand {{ | '<' ( 'const' | type ) '>' operand }} | update ;
update = ( '++' | '--' ) simple | enclosed NONL ( '++' | '--' ) | call ( ^PLACE NONL ( '++' | '--' ) )? ;
call = primary suffix* ;
suffix = '.' ( WORD | PRIVATE ) | '?.' ( WORD | PRIVATE | '[' expr ']' | {{ typeargs? }} args ) | '[' expr ']' | args | template {{ | typeargs ( args | template ) | NONL '!' }} ;
args = '(' ( arg % ',' ','? )? ')' ;
arg = '...'? assign ;
primary = NAME !'=>' | 'this' | 'super' | STR | NUM | REGEX | 'true' | 'false' | 'null' | template | array | object | '(' expr ')'
  | ( 'async' NONL )? 'function' '*'? NAME? signature block | decorator* 'class' NAME? classtail
  | 'new' '.' 'target' | 'new' call | 'import' ( '(' arg ( ',' arg )? ','? ')' | '.' ( 'meta' | ( 'defer' | 'source' ) args ) ) ;
template = TEMPLATE | HEAD expr ( MIDDLE expr )* TAIL ;
array = '[' ','* ( arg ( ','+ arg )* ','* )? ']' ;
object = '{' ( prop % ',' ','? )? '}' ;
prop = '...' assign | ( 'get' | 'set' ) propname signature block | ( 'async' NONL )? '*'? propname signature block | propname ':' assign | NAME ;
{{
annotation = ':' type ;
typeparams = '<' typeparam % ',' ','? '>' ;
typeparam = ( ( 'const' | 'in' | 'out' ) &WORD )* NAME ( 'extends' type )? ( '=' type )? ;
typeargs = '<' type % ',' '>' ;
type = 'asserts' NONL ( NAME | 'this' ) ( 'is' type )? | ( NAME | 'this' ) NONL 'is' type | functiontype | union ( NONL 'extends' union '?' type ':' type )? ;
functiontype = ( 'abstract'? 'new' )? typeparams? '(' params? ')' '=>' type ;
union = '|'? intersection ( '|' intersection )* ;
intersection = '&'? typeop ( '&' typeop )* ;
typeop = ( 'keyof' | 'unique' | 'readonly' ) typeop | 'infer' NAME ( 'extends' union !'?' )? | functiontype | primarytype ( NONL '[' type? ']' )* ;
primarytype = '(' type ')' | 'typeof' ( 'import' '(' STR ')' ( '.' WORD )* | qname ) typeargs? | 'import' '(' STR ')' ( '.' WORD )* typeargs? | '-'? NUM | STR | 'true' | 'false' | 'null' | 'void' | 'this'
  | typetemplate | objecttype | '[' ( tupleelem % ',' ','? )? ']' | qname ( NONL typeargs )? ;
typetemplate = TEMPLATE | HEAD type ( MIDDLE type )* TAIL ;
tupleelem = '...'? WORD '?'? ':' type | '...'? type '?'? ;
qname = ( NAME | 'this' ) ( '.' WORD )* ;
objecttype = '{' mapped '}' | '{' ( typemember ( ';' | ',' | NL | &'}' ) )* '}' ;
mapped = ( ( '+' | '-' )? 'readonly' )? '[' NAME 'in' type ( 'as' type )? ']' ( ( '+' | '-' )? '?' )? annotation? ';'? ;
typemember = 'new'? signature | indexsignature | ( 'get' | 'set' ) propname signature | ( 'readonly' !( ':' | '?' | '(' | ';' | ',' | '<' ) )? propname '?'? ( signature | annotation? ) ;
indexsignature = ( 'readonly' | 'static' )* '[' NAME ':' type ']' annotation ;
tsdecl = interfacedecl | 'type' NAME typeparams? '=' type eos | 'const'? enumdecl | 'abstract' classdecl
  | ( 'namespace' | 'module' ) NONL ( STR | NAME ( '.' NAME )* ) ( '{' moditem* '}' | eos )
  | 'declare' ( 'global' '{' moditem* '}' | ( 'var' | 'let' | 'const' ) ( ambient % ',' ) eos | declaration | moditem ) ;
ambient = target annotation? ( '=' assign )? ;
interfacedecl = 'interface' NAME typeparams? ( 'extends' ( type % ',' ) )? objecttype ;
enumdecl = 'enum' NAME '{' ( enummember % ',' ','? )? '}' ;
enummember = propname ( '=' assign )? ;
}}
"""


def _with_return(text: str) -> str:
    """The grammar text with its @ rules written twice."""
    doubled = [line for rule in re.findall(r"^\w+@ = .*?;$", text, re.M | re.S) for line in (rule, rule.replace("RETURN@ ", "").replace("@", "_top"))]
    others = re.sub(r"^\w+@ = .*?;$", "", text, flags=re.M | re.S)
    return re.sub(r"\b(\w+)@", r"\1", (others + "\n".join(doubled)).replace("RETURN@ ", "'return' ( NONL expr )? eos | "))


SCRIPT = _with_return(_SCRIPT)

PYTHON = """
SOFT := 'match' 'case' 'type' '_' ;
NAME := ID SOFT ;
AUGMENT := '+=' '-=' '*=' '/=' '//=' '%=' '@=' '&=' '|=' '^=' '>>=' '<<=' '**=' ;
BINARY := '+' '-' '*' '/' '//' '%' '@' '&' '|' '^' '<<' '>>' ;
COMPARE := '<' '>' '==' '>=' '<=' '!=' 'in' 'is' ;

file = stmt** EOF ;
stmt = compound | simples ;
simples = simple ( ';' simple )* ';'? NEWLINE ;
simple = 'type' NAME typeparams? '=' expr | assignment | value | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' ( expr ( 'from' expr )? )?
  | ( 'global' | 'nonlocal' ) ( NAME % ',' ) | 'del' ( target % ',' ) ','? | 'assert' expr ( ',' expr )? | imports ;
assignment = single ':' expr ( '=' value )? | ( targets '=' )+ value !'=' | single AUGMENT value ;
value = yield | stars ;
stars = star ( ',' star )* ','? ;
star = '*' bits | expr !':=' ;
targets = startarget ( ',' startarget )* ','? ;
startarget = '*'? target ;
target = place | NAME | '(' ( ( startarget ',' )+ startarget? | target )? ')' | '[' targets? ']' ;
single = place | NAME | '(' single ')' ;
place = atom ( call* ( '.' NAME | '[' slices ']' ) )+ !'(' ;
imports = 'import' ( dotted ( 'as' NAME )? ) ( ',' dotted ( 'as' NAME )? )*
  | 'from' ( '.' | '...' )* dotted? 'import' ( '*' | '(' aliased % ',' ','? ')' | aliased % ',' ) ;
aliased = NAME ( 'as' NAME )? ;
dotted = NAME ( '.' NAME )* ;

compound = decorators ( 'async'? def | class ) | 'async' ( def | with | for ) | def | class | if | while | for | with | try | match ;
decorators = ( '@' named NEWLINE )+ ;
block = NEWLINE INDENT stmt+ DEDENT | simples ;
class = 'class' NAME typeparams? ( '(' args? ')' )? ':' block ;
typeparams = '[' ( '*' | '**' )? NAME ( ':' expr )? ( '=' starexpr )? ( ',' ( '*' | '**' )? NAME ( ':' expr )? ( '=' starexpr )? )* ','? ']' ;
def = 'def' NAME typeparams? '(' params? ')' ( '->' expr )? ':' block ;
params = ( positional ( ',' starred )? | starred ) ','? ;
positional = plain ( ',' plain )* ( ',' '/' ( ',' plain )* ( ',' default )* | ( ',' default )+ ( ',' '/' ( ',' default )* )? )? | default ( ',' default )* ( ',' '/' ( ',' default )* )? ;
starred = '*' ( NAME ( ':' starexpr )? ( ',' keyword )* | ( ',' keyword )+ ) ( ',' '**' param )? | '**' param ;
param = NAME ( ':' expr )? ;
plain = param !'=' ;
default = param '=' expr ;
keyword = param ( '=' expr )? ;
lambda = 'lambda' ( ( lpositional ( ',' lstarred )? | lstarred ) ','? )? ':' expr ;
lpositional = lplain ( ',' lplain )* ( ',' '/' ( ',' lplain )* ( ',' ldefault )* | ( ',' ldefault )+ ( ',' '/' ( ',' ldefault )* )? )? | ldefault ( ',' ldefault )* ( ',' '/' ( ',' ldefault )* )? ;
lstarred = '*' ( NAME ( ',' lkeyword )* | ( ',' lkeyword )+ ) ( ',' '**' NAME )? | '**' NAME ;
lplain = NAME !'=' ;
ldefault = NAME '=' expr ;
lkeyword = NAME ( '=' expr )? ;
if = 'if' named ':' block ( 'elif' named ':' block )* ( 'else' ':' block )? ;
while = 'while' named ':' block ( 'else' ':' block )? ;
for = 'for' targets 'in' stars ':' block ( 'else' ':' block )? ;
with = 'with' ( '(' withitem % ',' ','? ')' ':' | withitem % ',' ':' ) block ;
withitem = expr ( 'as' startarget )? ;
try = 'try' ':' block ( ( 'except' '*'? ( expr ( 'as' NAME )? )? ':' block )+ ( 'else' ':' block )? ( 'finally' ':' block )? | 'finally' ':' block ) ;
match = 'match' exprs ':' NEWLINE INDENT case+ DEDENT ;
case = 'case' patterns ( 'if' named )? ':' block ;
patterns = pattern ( ',' pattern )* ','? ;
pattern = '*' NAME | closed ( '|' closed )* ( 'as' NAME )? ;
closed = '-'? NUM ( ( '+' | '-' ) NUM )? | string+ | 'None' | 'True' | 'False' | dotted ( '(' ( argpattern % ',' ','? )? ')' )?
  | '(' patterns? ')' | '[' patterns? ']' | '{' ( keypattern % ',' ','? )? '}' ;
argpattern = NAME '=' pattern | pattern ;
keypattern = '**' NAME | ( '-'? NUM | string+ | 'None' | 'True' | 'False' | dotted ) ':' pattern ;

exprs = starexpr ( ',' starexpr )* ','? ;
starexpr = '*' bits | named ;
named = NAME ':=' expr | expr !':=' ;
expr = lambda | or ( 'if' or 'else' expr )? ;
or = not ( ( 'and' | 'or' ) not )* ;
not = 'not'* bits ( ( COMPARE 'not'? | 'not' 'in' ) bits )* ;
bits = factor ( BINARY factor )* ;
factor = ( '+' | '-' | '~' )* power ;
power = primary ( '**' factor )? ;
primary = 'await'? atom ( '.' NAME | call | '[' slices ']' )* ;
call = '(' ( named comp+ | args )? ')' ;
atom = NAME | 'None' | 'True' | 'False' | NUM | string+ | '...' | '(' ( yield | comprehended | starexpr ',' exprs? | named )? ')' | '[' ( comprehended | exprs )? ']' | '{' ( dict | comprehended | exprs )? '}' ;
string = STR | FOPEN FTEXT? ( field FTEXT? )* FCLOSE ;
field = '{' value '='? ( CONV )? ( ':' ( FTEXT | field )* )? '}' ;
yield = 'yield' ( 'from' expr | stars )? ;
comprehended = ( named | '*' bits ) comp+ ;
comp = 'async'? 'for' targets 'in' or ( 'if' ( lambda | or ) )* ;
dict = ( pair comp+ | pair ( ',' pair )* ','? ) ;
pair = '**' bits | expr ':' expr ;
args = ( arg ( ',' arg )* ( ',' kwargs )? | kwargs ) ','? ;
arg = '*' expr | named !'=' ;
kwargs = kwarg ( ',' kwarg )* ( ',' kwlast ( ',' kwlast )* )? | kwlast ( ',' kwlast )* ;
kwarg = NAME '=' expr | '*' expr ;
kwlast = NAME '=' expr | '**' expr ;
slices = slice ( ',' slice )* ','? ;
slice = expr? ':' expr? ( ':' expr? )? | starexpr ;
"""

JAVA = """
CONTEXTUAL := 'var' 'record' 'sealed' 'permits' 'yield' 'when' 'module' 'requires' 'exports' 'opens' 'uses' 'provides' 'to' 'with' 'transitive' 'open' 'non-sealed' ;
NAME := ID CONTEXTUAL ;
PRIMITIVE := 'boolean' 'byte' 'short' 'int' 'long' 'char' 'float' 'double' ;
MODIFIER := 'public' 'protected' 'private' 'static' 'abstract' 'final' 'native' 'synchronized' 'transient' 'volatile' 'strictfp' 'default' 'sealed' 'non-sealed' ;
ASSIGN := '=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' '>>>=' ;
BINARY := '+' '-' '*' '/' '%' '<' '<=' '>=' '==' '!=' '&' '|' '^' '&&' '||' '<<' ;

PLACE := NAME ']' ;

file = ( annotation* 'package' qname ';' )? ( ';' | import )* ( moduledecl | ( ';' | typedecl )** ) EOF ;
import = 'import' 'static'? NAME ( '.' NAME )* ( '.' '*' )? ';' ;
qname = NAME ( '.' NAME )* ;
moduledecl = annotation* 'open'? 'module' qname '{' ( ( 'requires' ( 'transitive' | 'static' )* qname | ( 'exports' | 'opens' ) qname ( 'to' qname % ',' )? | 'uses' qname | 'provides' qname 'with' qname % ',' ) ';' )* '}' ;
modifiers = ( annotation | MODIFIER !( ':' | '->' | '.' | '=' | '(' ) )* ;
annotation = '@' !'interface' qname ( '(' ( annpairs % ',' | element )? ')' )? ;
annotations = annotation* ;
element = annotation | '{' ( element % ',' )? ','? '}' | conditional ;
annpairs = NAME '=' element ;
typedecl = modifiers typebody ;
typebody = 'class' NAME typeparams? ( 'extends' type )? ( 'implements' type % ',' )? ( 'permits' type % ',' )? classbody
  | 'interface' NAME typeparams? ( 'extends' type % ',' )? ( 'permits' type % ',' )? classbody
  | 'enum' NAME ( 'implements' type % ',' )? '{' ( enumconst % ',' )? ','? ( ';' member* )? '}'
  | 'record' NAME typeparams? '(' ( params )? ')' ( 'implements' type % ',' )? classbody
  | '@' 'interface' NAME classbody ;
enumconst = annotations NAME args? classbody? ;
classbody = '{' member* '}' ;
member = ';' | 'static'? block | modifiers ( typebody | method | NAME block | fielddecl ) ;
method = typeparams? annotations ( ( type | 'void' ) NAME | NAME ) '(' params? ')' dims ( 'throws' type % ',' )? ( block | ( 'default' element )? ';' ) ;
fielddecl = type vardef % ',' ';' ;
vardef = NAME dims ( '=' init )? ;
init = arrayinit | expr ;
arrayinit = '{' ( init % ',' )? ','? '}' ;
dims = ( annotation* '[' ']' )* ;
params = param % ',' ;
param = ( annotation | 'final' )* type annotations '...'? ( ( NAME '.' )* 'this' | NAME dims ) ;
typeparams = '<' typeparam % ',' '>' ;
typeparam = annotations NAME ( 'extends' type ( '&' type )* )? ;
type = annotations ( PRIMITIVE | classtype ) dims ;
classtype = NAME typeargs? ( '.' annotations NAME typeargs? )* ;
typeargs = '<' ( typearg % ',' )? '>' ;
typearg = annotations '?' ( ( 'extends' | 'super' ) type )? | type ;

block = '{' blockstmt* '}' ;
blockstmt = localtype | localvar ';' | stmt ;
localtype = ( annotation | 'final' | 'abstract' | 'static' | 'sealed' | 'non-sealed' | 'strictfp' )* ( &( 'class' | 'interface' | 'enum' | 'record' NAME ( '(' | '<' ) | '@' ) typebody ) ;
localvar = ( annotation | 'final' )* type vardef % ',' ;
stmt = block | ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' ( ( annotation | 'final' )* type NAME dims ':' expr ')' | ( localvar | statementexpr % ',' )? ';' expr? ';' ( statementexpr % ',' )? ')' ) stmt
  | 'switch' '(' expr ')' switchbody | 'try' ( resources block ( catch )* ( 'finally' block )? | block ( catch+ ( 'finally' block )? | 'finally' block ) )
  | 'synchronized' '(' expr ')' block | 'return' expr? ';' | 'throw' expr ';' | 'break' NAME? ';' | 'continue' NAME? ';'
  | 'yield' !( '=' | '.' | '++' | '--' | '[' ) expr ';' | 'assert' expr ( ':' expr )? ';' | NAME ':' stmt | statementexpr ';' ;
statementexpr = ( '++' | '--' ) unary | place ASSIGN expr | postfixed ( '++' | '--' )
  | ( NAME args | ( 'this' | 'super' ) args | 'new' newobject ) ( quiet* called )* | primary ( quiet* called )+ ;
called = '.' ( typeargs? NAME args | 'new' newobject | 'super' args ) ;
quiet = '.' ( NAME !'(' | 'this' | 'super' !'(' ) | '[' expr ']' ;
newobject = typeargs? annotations classtype args classbody? ;
resources = '(' ( ( localvar | postfixed ) % ';' ) ';'? ')' ;
catch = 'catch' '(' ( annotation | 'final' )* type ( '|' type )* NAME ')' block ;
switchbody = '{' ( ( caselabel ( '->' ( block | 'throw' expr ';' | expr ';' ) | ( ':' caselabel )* ':' blockstmt* ) ) )* '}' ;
caselabel = 'case' ( ( 'default' | casepattern | conditional ) % ',' ) ( 'when' expr )? | 'default' ;
casepattern = ( 'final' | annotation )* type NAME &( ':' | '->' | ',' | 'when' | '&&' ) | recordpattern ;
recordpattern = classtype '(' ( ( recordpattern | type NAME ) % ',' )? ')' NAME? ;

expr = lambda | place ASSIGN expr | conditional ;
place = '(' place ')' &ASSIGN | postfixed ^PLACE ;
lambda = ( NAME | '(' ( NAME % ',' )? ')' | '(' params ')' ) '->' ( block | expr ) ;
conditional = binary ( '?' expr ':' ( lambda | conditional ) )? ;
binary = unary ( ( BINARY | shift ) unary | 'instanceof' ( ( 'final' | annotation )* ( recordpattern | type NAME? ) ) )* ;
shift = '>' ( '>' '>'? )? ;
unary = ( '+' | '-' | '++' | '--' | '!' | '~' ) unary | cast | postfixed ( '++' | '--' )* ;
cast = '(' annotations PRIMITIVE dims ')' unary | '(' type ( '&' type )* ')' ( lambda | &( NAME | STR | NUM | CHAR | '(' | '!' | '~' | 'this' | 'super' | 'new' | 'true' | 'false' | 'null' | 'switch' | PRIMITIVE ) unary ) ;
postfixed = primary suffix* ;
suffix = '.' ( typeargs? NAME args? | 'this' | 'new' creator | 'super' ( args | ) | 'class' ) | '[' expr ']' | '::' typeargs? ( NAME | 'new' ) ;
args = '(' ( expr % ',' )? ')' ;
primary = 'switch' '(' expr ')' switchbody | '(' expr ')' | 'this' args? | 'super' args? | STR | NUM | CHAR | 'true' | 'false' | 'null' | 'new' creator
  | 'void' '.' 'class' | type ( '.' 'class' | '::' ( NAME | 'new' ) ) | NAME args? ;
creator = typeargs? annotations ( PRIMITIVE | classtype ) ( args classbody? | ( annotation* '[' ']' )+ arrayinit | ( annotation* '[' expr ']' )+ dims ) ;
"""

GO = """
ASSIGN := '=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' '&^=' ;
BINARY := '+' '-' '*' '/' '%' '&' '|' '^' '<<' '>>' '&^' '==' '!=' '<' '<=' '>' '>=' '&&' '||' ;
UNARY := '+' '-' '!' '^' '*' '&' '<-' ;

file = 'package' ID ';' ( importdecl ';' )* ( topdecl ( ';' | &EOF ) )** EOF ;
importdecl = 'import' ( importspec | '(' ( importspec % ';' ';'? )? ')' ) ;
importspec = ( '.' | ID )? STR ;
topdecl = decl | funcdecl ;
decl = 'const' ( constspec | '(' ( constspec % ';' ';'? )? ')' ) | 'var' ( varspec | '(' ( varspec % ';' ';'? )? ')' ) | 'type' ( typespec | '(' ( typespec % ';' ';'? )? ')' ) ;
idlist = ID % ',' ;
constspec = idlist ( type? '=' exprs )? ;
varspec = idlist ( '=' exprs | type ( '=' exprs )? ) ;
typespec = ID '=' type | ID typeparams type | ID type ;
typeparams = '[' ( idlist constraint ) % ',' ','? ']' ;
constraint = term ( '|' term )* ;
term = '~'? type ;
funcdecl = 'func' params? ID typeparams? signature block? ;
signature = params ( result )? ;
result = params | type ;
params = '(' ( param % ',' ','? )? ')' ;
param = ID '...'? type | '...' type | type ;
type = qualified typeargs? | '(' type ')' | '[' ']' type | '[' ( '...' | expr ) ']' type | '*' type | 'func' signature | 'map' '[' type ']' type
  | 'chan' '<-'? type | '<-' 'chan' type | structtype | interfacetype ;
qualified = ID ( '.' ID )? ;
typeargs = '[' type % ',' ','? ']' ;
structtype = 'struct' '{' ( field % ';' ';'? )? '}' ;
field = ( idlist type | '*'? qualified typeargs? ) STR? ;
interfacetype = 'interface' '{' ( ( ID signature | constraint ) % ';' ';'? )? '}' ;

block = '{' stmts '}' ;
stmts = ( stmt ( ';' | &'}' | &'case' | &'default' ) | ';' )* ;
stmt = decl | ID ':' stmt? | 'go' expr | 'defer' expr | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | switch | select | for | simple ;
simple = exprs ( ( ':=' | ASSIGN ) exprs | '<-' expr | '++' | '--' )? ;
simple_h = exprs_h ( ( ':=' | ASSIGN ) exprs_h | '<-' expr_h | '++' | '--' )? ;
if = 'if' ( simple_h? ';' )? expr_h block ( 'else' ( if | block ) )? ;
switch = 'switch' ( simple_h? ';' )? ( guard | simple_h )? '{' ( ( 'case' ( type | expr ) ( ',' ( type | expr ) )* | 'case' exprs | 'default' ) ':' stmts )* '}' ;
guard = ( ID ':=' )? operand_h suffix* '.' '(' 'type' ')' ;
select = 'select' '{' ( ( 'case' simple | 'default' ) ':' stmts )* '}' ;
for = 'for' ( ( exprs_h ( ':=' | '=' ) )? 'range' expr_h block | simple_h? ';' expr_h? ';' simple_h? block | expr_h? block ) ;

exprs = expr % ',' ;
exprs_h = expr_h % ',' ;
expr = unary ( BINARY unary )* ;
expr_h = unary_h ( BINARY unary_h )* ;
unary = UNARY unary | primary ;
unary_h = UNARY unary_h | primary_h ;
primary = operand suffix* ;
primary_h = operand_h suffix* ;
suffix = '.' ID | '.' '(' type ')' | '[' expr? ':' expr? ( ':' expr )? ']' | '[' ( type | expr ) ( ',' type )* ','? ']' literal? | '(' callargs? ')' ;
callargs = ( ( expr | type ) % ',' ) '...'? ','? ;
operand = literals | 'func' signature block | '(' ( expr | type ) ')' | qualified typeargs literal | qualified literal | ID | composite | conversion ;
operand_h = literals | 'func' signature block | '(' ( expr | type ) ')' | ID !( '[' type ']' '{' '}' ) | composite | conversion ;
literals = NUM | STR | CHAR ;
composite = ( '[' ( '...' | expr )? ']' type | 'map' '[' type ']' type | structtype ) literal ;
conversion = ( '[' expr? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | 'interface' '{' '}' | structtype | 'func' signature ) &( '(' | ',' | ')' ) ;
literal = '{' ( element % ',' ','? )? '}' ;
element = ( literal | expr ) ( ':' ( literal | expr ) )? ;
"""

RUST = """
CONTEXTUAL := 'union' 'auto' 'default' 'macro_rules' 'raw' ;
NAME := ID CONTEXTUAL ;
PATHSEG := NAME 'self' 'Self' 'super' 'crate' ;
ASSIGN := '=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' ;
ARITHMETIC := '+' '-' '*' '/' '%' '&' '|' '^' '<<' ;
COMPARE := '==' '!=' '<' '<=' '>=' '>' ;
BINARY := ARITHMETIC '==' '!=' '<' '<=' '>=' '&&' '||' ;
LIT := NUM STR CHAR 'true' 'false' ;
LEAF := NAME LIT LIFETIME 'as' 'async' 'await' 'break' 'const' 'continue' 'crate' 'dyn' 'else' 'enum' 'extern' 'fn' 'for' 'if' 'impl' 'in' 'let' 'loop' 'match'
  'mod' 'move' 'mut' 'pub' 'ref' 'return' 'self' 'Self' 'static' 'struct' 'super' 'trait' 'type' 'unsafe' 'use' 'where' 'while' 'abstract' 'become' 'box' 'do'
  'final' 'macro' 'override' 'priv' 'typeof' 'unsized' 'virtual' 'yield' 'try' '_' ASSIGN BINARY '!' '~' '@' '.' '..' '...' '..=' ',' ';' ':' '::' '->' '=>' '<-' '#' '$' '?' '>' ;

file = innerattr* item** EOF ;
innerattr = '#' '!' '[' tree* ']' ;
attr = '#' '[' tree* ']' ;
tree = LEAF | '(' tree* ')' | '[' tree* ']' | '{' tree* '}' ;
delimited = '(' tree* ')' | '[' tree* ']' | '{' tree* '}' ;
visibility = 'pub' ( '(' ( 'in' path | 'crate' | 'self' | 'super' ) ')' )? ;
item = attr* ( visibility? bare | macroitem ) ;
macroitem = 'macro_rules' '!' NAME ( '{' tree* '}' | '(' tree* ')' ';' | '[' tree* ']' ';' ) | path '!' ( '{' tree* '}' | '(' tree* ')' ';' | '[' tree* ']' ';' ) ;
bare = 'mod' NAME ( ';' | '{' innerattr* item* '}' ) | 'extern' 'crate' ( NAME | 'self' ) ( 'as' ( NAME | '_' ) )? ';' | 'use' usetree ';'
  | fn | 'type' NAME generics? ( ':' bounds )? where? ( '=' type )? where? ';'
  | 'struct' NAME generics? ( where? '{' fields? '}' | '(' tuplefields? ')' where? ';' | where? ';' ) | 'enum' NAME generics? where? '{' ( variant % ',' ','? )? '}'
  | 'union' NAME generics? where? '{' fields? '}' | 'const' ( NAME | '_' ) ':' type ( '=' expr )? ';' | 'static' 'mut'? NAME ':' type ( '=' expr )? ';'
  | 'unsafe'? 'auto'? 'trait' NAME generics? ( ':' bounds? )? where? '{' innerattr* item* '}'
  | 'default'? 'unsafe'? 'impl' ( generics !'::' )? 'const'? ( '!'? type 'for' )? type where? '{' innerattr* item* '}'
  | 'unsafe'? 'extern' STR? '{' innerattr* item* '}' ;
fn = ( 'default' | 'const' | 'async' | 'unsafe' | 'extern' STR? )* 'fn' NAME generics? '(' ( fnparam % ',' ','? )? ')' ( '->' type )? where? ( block | ';' ) ;
fnparam = attr* ( ( '&' LIFETIME? )? 'mut'? 'self' ( ':' type )? | '...' | pattern ':' type ) ;
usetree = ( ( path? '::' )? ( '*' | '{' ( usetree % ',' ','? )? '}' ) ) | usepath ( '::' ( '*' | '{' ( usetree % ',' ','? )? '}' ) )? ( 'as' ( NAME | '_' ) )? ;
usepath = '::'? PATHSEG ( '::' PATHSEG )* ;
fields = field % ',' ','? ;
field = attr* visibility? NAME ':' type ;
tuplefields = ( attr* visibility? type ) % ',' ','? ;
variant = attr* visibility? NAME ( '{' fields? '}' | '(' tuplefields? ')' )? ( '=' expr )? ;
generics = '<' ( generic % ',' ','? )? '>' ;
generic = attr* ( LIFETIME ( ':' ( LIFETIME % '+' )? )? | 'const' NAME ':' type ( '=' ( block | '-'? LIT | NAME ) )? | NAME ( ':' bounds? )? ( '=' type )? ) ;
where = 'where' ( ( LIFETIME ':' ( LIFETIME % '+' )? | forall? type ':' bounds? ) % ',' ','? )? ;
bounds = bound ( '+' bound )* '+'? ;
bound = LIFETIME | '(' bound ')' | ( '?' | '~' 'const' )? forall? path ;
forall = 'for' '<' ( LIFETIME % ',' ','? )? '>' ;
type = '(' ( type % ',' ','? )? ')' | '!' | '*' ( 'const' | 'mut' ) type | '&' LIFETIME? 'mut'? type | '&&' LIFETIME? 'mut'? type | '[' type ( ';' expr )? ']' | '_'
  | forall? ( 'unsafe' | 'extern' STR? )* 'fn' '(' ( ( ( NAME | '_' ) ':' )? ( '...' | type ) ) % ',' ','? ')' ( '->' type )? | forall? ( 'unsafe' | 'extern' STR? )* 'fn' '(' ')' ( '->' type )?
  | ( 'dyn' | 'impl' ) bounds | '<' type ( 'as' path )? '>' ( '::' segment )+ | forall? path ( '!' delimited )? ;
path = '::'? segment ( '::' segment )* ;
segment = PATHSEG ( '::'? typeargs | '(' ( type % ',' ','? )? ')' ( '->' type )? )? ;
typeargs = '<' ( typearg % ',' ','? )? '>' ;
typearg = LIFETIME | NAME typeargs? ( '=' type | ':' bounds ) | type | block | '-'? LIT ;

block = '{' innerattr* stmt* expr? '}' ;
stmt = ';' | attr* let | !macrostart item | attr* blocklike !( '.' | '?' ) ';'? | attr* path '!' '{' tree* '}' !( '.' | '?' ) ';'? | attr* expr ';' ;
macrostart = path '!' ;
let = 'let' pattern ( ':' type )? ( '=' expr ( 'else' block )? )? ';' ;
blocklike = ( LIFETIME ':' )? ( 'unsafe' block | 'async' 'move'? block | 'const' block | 'loop' block | 'while' cond block | 'for' pattern 'in' expr_h block | block ) | if | match ;
if = 'if' cond block ( 'else' ( if | block ) )? ;
cond = condpart ( '&&' condpart )* ;
condpart = 'let' pattern '=' unary_h ( '..' unary_h? )? | expr_h ;
match = 'match' expr_h '{' innerattr* ( arm )* '}' ;
arm = attr* pattern ( 'if' cond_g )? '=>' ( blocklike !( '.' | '?' | BINARY ) ','? | expr ( ',' | &'}' ) ) ;
cond_g = ( 'let' pattern '=' unary | expr ) ( '&&' ( 'let' pattern '=' unary ) )* ;

pattern = '|'? onepattern ( '|' onepattern )* ;
onepattern = ( rangeend? ( '..=' | '...' | '..' ) rangeend ) | rangeend '..' | '..' | '_' | 'ref'? 'mut'? NAME !( '::' | '(' | '{' | '!' ) ( '@' onepattern )? | '-'? LIT
  | ( '&' | '&&' ) 'mut'? onepattern | '(' ( pattern % ',' ','? )? ')' | '[' ( pattern % ',' ','? )? ']' | 'box' onepattern
  | pathexpr ( '(' ( pattern % ',' ','? )? ')' | '{' ( fieldpattern % ',' ','? )? '}' | '!' delimited )? | 'const' block ;
rangeend = '-'? LIT | pathexpr ;
fieldpattern = attr* ( '..' | ( NAME | NUM ) ':' pattern | 'ref'? 'mut'? NAME ) ;

expr = assign ;
assign = range ( ASSIGN assign )? ;
range = ( '..' | '..=' ) ( binary )? | binary ( ( '..=' binary ) | '..' binary? )? ;
binary = comparison ( ( '&&' | '||' ) comparison )* ;
comparison = arithmetic ( COMPARE arithmetic !COMPARE )? ;
arithmetic = unary ( ( ARITHMETIC | '>' '>' ) unary | 'as' type )* ;
unary = ( '-' | '!' | '*' | ( '&' | '&&' ) ( 'raw' ( 'const' | 'mut' ) | 'mut' )? ) unary | postfix ;
postfix = primary suffix* ;
suffix = '?' | '.' ( 'await' | NUM | NAME ( '::' typeargs )? ( '(' exprlist? ')' )? ) | '(' exprlist? ')' | '[' expr ']' ;
exprlist = ( attr* expr ) % ',' ','? ;
primary = LIT | closure | jump | blocklike | '(' exprlist? ')' | '[' ( expr ';' expr | exprlist )? ']' | pathexpr '!' delimited | pathexpr '{' fieldinits '}' | pathexpr ;
fieldinits = ( ( attr* ( NAME | NUM ) ( ':' expr )? ) % ',' ( ',' '..' expr? )? ','? )? ( '..' expr? )? ;
closure = ( forall )? 'static'? 'async'? 'move'? ( '||' | '|' ( ( pattern_c ( ':' type )? ) % ',' ','? )? '|' ) ( '->' type block | expr ) ;
pattern_c = attr* onepattern ;
jump = 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? | '_' ;
pathexpr = '<' type ( 'as' path )? '>' ( '::' exprseg )+ | '::'? exprseg ( '::' exprseg )* ;
exprseg = PATHSEG ( '::' typeargs )? ;

expr_h = assign_h ;
assign_h = range_h ( ASSIGN assign_h )? ;
range_h = ( '..' | '..=' ) binary_h? | binary_h ( ( '..=' binary_h ) | '..' binary_h? )? ;
binary_h = comparison_h ( ( '&&' | '||' ) comparison_h )* ;
comparison_h = arithmetic_h ( COMPARE arithmetic_h !COMPARE )? ;
arithmetic_h = unary_h ( ( ARITHMETIC | '>' '>' ) unary_h | 'as' type )* ;
unary_h = ( '-' | '!' | '*' | ( '&' | '&&' ) 'mut'? ) unary_h | primary_h suffix* ;
primary_h = LIT | closure | jump_h | blocklike | '(' exprlist? ')' | '[' ( expr ';' expr | exprlist )? ']' | pathexpr '!' delimited | pathexpr ;
jump_h = 'return' expr_h? | 'break' LIFETIME? | 'continue' LIFETIME? ;
"""

KOTLIN = """
SOFT := 'abstract' 'annotation' 'by' 'catch' 'companion' 'constructor' 'crossinline' 'data' 'enum' 'external' 'final' 'finally' 'get' 'import' 'infix' 'init' 'inline' 'inner' 'internal'
  'lateinit' 'noinline' 'open' 'operator' 'out' 'override' 'private' 'protected' 'public' 'reified' 'sealed' 'tailrec' 'set' 'vararg' 'where' 'suspend' 'value' 'expect' 'actual' 'const'
  'file' 'field' 'property' 'receiver' 'param' 'setparam' 'delegate' 'dynamic' ;
NAME := ID SOFT ;
MODIFIER := 'abstract' 'annotation' 'companion' 'crossinline' 'data' 'enum' 'external' 'final' 'infix' 'inline' 'inner' 'internal' 'lateinit' 'noinline' 'open' 'operator' 'out' 'override'
  'private' 'protected' 'public' 'reified' 'sealed' 'tailrec' 'vararg' 'suspend' 'value' 'expect' 'actual' 'const' 'in' ;
ASSIGN := '=' '+=' '-=' '*=' '/=' '%=' ;
LOWBIN := '&&' '||' '?:' ;
SAMELINE := '*' '/' '%' '+' '-' '<' '<=' '>=' '==' '!=' '===' '!==' '..' '..<' ;

file = ( '@' 'file' ':' ( NAME ( '.' NAME )* | '[' tree* ']' ) args? )* ( 'package' qname semi )? ( 'import' qname ( '.' '*' )? ( 'as' NAME )? semi )* ( decl semi? )** EOF ;
tree = NAME | STR | '.' | ',' ;
semi = ';'+ | NL | &EOF | &'}' ;
qname = NAME ( '.' NAME )* ;
modifiers = ( annotation | 'fun' &'interface' | MODIFIER &( MODIFIER | NAME | 'class' | 'interface' | 'object' | 'fun' | 'val' | 'var' | 'typealias' | '@' ) )* ;
annotation = '@' ( NAME ':' )? ( '[' ( usertype args? )+ ']' | usertype ( NONL args )? ) ;
decl = modifiers declbody ;
declbody = classdecl | 'object' NAME? ( ':' supers )? classbody? | fun | prop | 'typealias' NAME typeparams? '=' type
  | 'constructor' params ( ':' ( 'this' | 'super' ) args )? block? | 'init' block ;
classdecl = ( 'class' | 'interface' ) NAME? typeparams? ( modifiers 'constructor' params | params )? ( ':' supers )? where? classbody? ;
supers = super % ',' ;
super = annotation* ( type_s ( args | 'by' expr )? ) ;
type_s = functiontype | usertype ;
classbody = '{' ( enumentries ( ';' ( decl semi? | ';' )* )? | ( decl semi? | ';' )* ) '}' ;
enumentries = enumentry ( ',' enumentry )* ','? &( '}' | ';' ) ;
enumentry = annotation* NAME !( NAME ) args? classbody? ;
typeparams = '<' ( modifiers NAME ( ':' type )? ) % ',' ','? '>' ;
where = 'where' ( annotation* NAME ':' type ) % ',' ;
params = '(' ( param % ',' ','? )? ')' ;
param = modifiers ( 'val' | 'var' )? NAME ':' type ( '=' expr )? ;
fun = 'fun' typeparams? ( receiver '.' )? NAME params ( ':' type )? where? ( block | '=' expr )? ;
receiver = annotation* ( '(' type ')' '?'* | usertypeone ( '.' usertypeone &'.' )* '?'* ) ;
usertypeone = NAME typeargs? ;
prop = ( 'val' | 'var' ) typeparams? ( receiver '.' )? ( multivar | NAME ( ':' type )? ) where? ( ( '=' | 'by' ) expr )? ';'? accessor? accessor? ;
accessor = modifiers ( 'get' ( '(' ')' ( ':' type )? ( block | '=' expr ) )? | 'set' ( '(' modifiers NAME ( ':' type )? ','? ')' ( ':' type )? ( block | '=' expr ) )? ) &( NL | ';' | '}' | EOF ) ;
multivar = '(' ( annotation* ( NAME | '_' ) ( ':' type )? ) % ',' ','? ')' ;
type = ( annotation | 'suspend' &( '(' | NAME ) )* ( functiontype | nullable ) ( '&' type )? ;
functiontype = ( nullable '.' )? '(' ( ( NAME ':' type | type ) % ',' ','? )? ')' '->' type ;
nullable = ( '(' type ')' | 'dynamic' | usertype ) '?'* ;
usertype = usertypeone ( '.' usertypeone )* ;
typeargs = '<' ( ( '*' | ( 'in' | 'out' )? type ) % ',' ','? ) '>' ;

block = '{' stmts '}' ;
stmts = ';'* ( stmt semi )* ;
stmt = ( NAME '@' )? annotation* ( localdecl | loop | assignment | expr ) ;
localdecl = modifiers ( prop | fun | classdecl | 'object' NAME ( ':' supers )? classbody? | 'typealias' NAME '=' type ) ;
loop = 'for' '(' annotation* ( multivar | NAME ( ':' type )? ) 'in' expr ')' body | 'while' '(' expr ')' body | 'do' body? 'while' '(' expr ')' ;
body = block | stmt | ';' ;
assignment = postfix ASSIGN expr ;

expr = unary ( operator unary | NONL ( 'as' | 'as?' | 'is' | '!is' ) type | ( 'as' | 'as?' ) type )* ;
operator = LOWBIN | NONL ( SAMELINE | '>' | 'in' | '!in' | !'where' NAME !( '->' | '=' | ':' ) ) ;
unary = ( '+' | '-' | '!' | '!!' | '++' | '--' | annotation | NAME '@' )* postfix ;
postfix = primary suffix* ;
suffix = '.' ( NAME | 'class' | '(' expr ')' ) | '?.' NAME | '::' ( NAME | 'class' ) | NONL ( '++' | '--' | '!!' | '!' '!' | args trailing? | trailing | '[' ( expr % ',' ','? ) ']' | typeargs ( args trailing? | trailing ) ) | '?' '::' ( NAME | 'class' ) ;
args = '(' ( ( ( NAME '=' )? '*'? expr ) % ',' ','? )? ')' ;
trailing = annotation* ( NAME '@' )? lambda ;
lambda = '{' ( lambdaparams? '->' )? stmts '}' ;
lambdaparams = ( ( multivar ( ':' type )? | ( NAME | '_' ) ( ':' type )? ) % ',' ) ','? ;
primary = 'fun' ( type '.' )? params ( ':' type )? ( block | '=' expr ) | 'suspend' lambda | NAME | '_' | NUM | CHAR | 'true' | 'false' | 'null' | string | '(' expr ')' | lambda | '[' ( expr % ',' ','? )? ']'
  | 'this' THISAT? | 'super' ( '<' type '>' )? THISAT? | if | when | try | 'object' ( ':' supers )? classbody | jump | '::' ( NAME | 'class' ) ;
string = STR | OPEN ( PART | VAR | '${' stmts '}' )* CLOSE ;
if = 'if' '(' expr ')' ( body ';'? 'else' body | body | ';' ( 'else' body )? ) ;
when = 'when' ( '(' ( annotation* 'val' NAME ( ':' type )? '=' )? expr ')' )? '{' ( ( ( whencond % ',' ','? ) ( 'if' expr )? | 'else' ) '->' body semi )* '}' ;
whencond = ( 'in' | '!in' ) expr | ( 'is' | '!is' ) type | expr ;
try = 'try' block ( ( 'catch' '(' annotation* NAME ':' type ','? ')' block )+ ( 'finally' block )? | 'finally' block ) ;
jump = 'throw' expr | 'return' THISAT? ( NONL expr )? | 'continue' THISAT? | 'break' THISAT? ;
"""
