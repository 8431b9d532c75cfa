"""The rules of Python 3.12 and C++17 over token kinds, for parsing with derivatives.

Quoted words are tokens, capitals token classes, small letters rules; ``?``, ``*`` and ``+`` follow what they repeat.
Both grammars are ambiguous where the languages are (soft keywords, types and expressions, template brackets): the
derivative follows all readings at once.
"""

from __future__ import annotations

import re

PYTHON = """
file = statement* ;
statement = simple_line | compound ;
simple_line = simple (';' simple)* ';'? NEWLINE ;
block = simple_line | NEWLINE INDENT statement+ DEDENT ;
simple = assignment | star_expressions | 'return' star_expressions? | import | 'raise' (expression ('from' expression)?)? | 'pass' | 'break' | 'continue' | 'del' del_targets | yield_expr | 'assert' expression (',' expression)? | ('global' | 'nonlocal') name (',' name)* | 'type' name type_params? '=' expression ;
name = NAME | 'match' | 'case' | 'type' | '_' ;

assignment = (star_targets '=')+ (yield_expr | star_expressions) | single_target AUGMENT (yield_expr | star_expressions) | (name | '(' single_target ')' | place) ':' expression ('=' (yield_expr | star_expressions))? ;
single_target = place | name | '(' single_target ')' ;
place = atom trailer* ('.' name | '[' slices ']') ;
star_targets = star_target (',' star_target)* ','? ;
star_target = '*'? target ;
target = place | name | '(' star_targets? ')' | '[' star_targets? ']' ;
del_targets = del_target (',' del_target)* ','? ;
del_target = place | name | '(' del_targets? ')' | '[' del_targets? ']' ;

import = 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imported (',' imported)* | '(' imported (',' imported)* ','? ')') ;
imported = name ('as' name)? ;
dotted = name ('.' name)* ;

compound = decorator* ('class' name type_params? ('(' arguments? ')')? ':' block | 'async'? 'def' name type_params? '(' params? ')' ('->' expression)? ':' block) | if | 'while' named ':' block else? | 'async'? 'for' star_targets 'in' star_expressions ':' block else? | 'async'? 'with' with_items ':' block | try | match ;
decorator = '@' named NEWLINE ;
if = 'if' named ':' block ('elif' named ':' block)* else? ;
else = 'else' ':' block ;
with_items = with_item (',' with_item)* | '(' with_item (',' with_item)* ','? ')' ;
with_item = expression ('as' star_target)? ;
try = 'try' ':' block (finally | except+ else? finally? | except_group+ else? finally?) ;
finally = 'finally' ':' block ;
except = 'except' (expression ('as' name)?)? ':' block ;
except_group = 'except' '*' expression ('as' name)? ':' block ;
type_params = '[' type_param (',' type_param)* ','? ']' ;
type_param = name (':' expression)? ('=' expression)? | '*' name ('=' star_expression)? | '**' name ('=' expression)? ;

match = 'match' subject ':' NEWLINE INDENT case+ DEDENT ;
subject = named | star_named ',' (star_named (',' star_named)* ','?)? ;
case = 'case' patterns ('if' named)? ':' block ;
patterns = pattern | maybe_star ',' (maybe_star (',' maybe_star)* ','?)? ;
maybe_star = '*' name | pattern ;
pattern = or_pattern ('as' name)? ;
or_pattern = closed ('|' closed)* ;
closed = number_pattern | STRING+ | BYTES+ | 'None' | 'True' | 'False' | name ('.' name)* ('(' class_args? ')')? | '(' pattern ')' | '(' (maybe_star ',' (maybe_star (',' maybe_star)* ','?)?)? ')' | '[' (maybe_star (',' maybe_star)* ','?)? ']' | '{' (map_item (',' map_item)* ','?)? '}' ;
number_pattern = '-'? NUMBER (('+' | '-') NUMBER)? ;
map_item = (number_pattern | STRING+ | BYTES+ | 'None' | 'True' | 'False' | name ('.' name)+) ':' pattern | '**' name ;
class_args = pattern class_args_rest | name '=' pattern class_keys_rest ;
class_args_rest = (',' (pattern class_args_rest | name '=' pattern class_keys_rest)?)? ;
class_keys_rest = (',' (name '=' pattern class_keys_rest)?)? ;

params = plain params_a | default params_b | star_params | kw_params ;
params_a = (',' (plain params_a | default params_b | '/' params_c | star_params | kw_params)?)? ;
params_b = (',' (default params_b | '/' params_d | star_params | kw_params)?)? ;
params_c = (',' (plain params_c | default params_d | star_params | kw_params)?)? ;
params_d = (',' (default params_d | star_params | kw_params)?)? ;
star_params = '*' name (':' star_expression)? params_k | '*' ',' (plain | default) params_k ;
params_k = (',' ((plain | default) params_k | kw_params)?)? ;
kw_params = '**' plain ','? ;
plain = name (':' expression)? ;
default = plain '=' expression ;
lambda = 'lambda' l_params? ':' expression ;
l_params = name l_a | l_default l_b | l_star | l_kw ;
l_a = (',' (name l_a | l_default l_b | '/' l_c | l_star | l_kw)?)? ;
l_b = (',' (l_default l_b | '/' l_d | l_star | l_kw)?)? ;
l_c = (',' (name l_c | l_default l_d | l_star | l_kw)?)? ;
l_d = (',' (l_default l_d | l_star | l_kw)?)? ;
l_star = '*' name l_k | '*' ',' (name | l_default) l_k ;
l_k = (',' ((name | l_default) l_k | l_kw)?)? ;
l_kw = '**' name ','? ;
l_default = name '=' expression ;

star_expressions = star_expression (',' star_expression)* ','? ;
star_expression = '*' arithmetic | expression ;
star_named = '*' arithmetic | named ;
named = name ':=' expression | expression ;
yield_expr = 'yield' ('from' expression | star_expressions)? ;
expression = disjunction ('if' disjunction 'else' expression)? | lambda ;
disjunction = inversion (('and' | 'or') inversion)* ;
inversion = 'not'* comparison ;
comparison = arithmetic (COMPARE arithmetic | ('<' | '>' | 'in' | 'is') arithmetic | 'not' 'in' arithmetic | 'is' 'not' arithmetic)* ;
arithmetic = unary ((BINARY | '+' | '-' | '*' | '**' | '/' | '@' | '|') unary)* ;
unary = ('+' | '-' | '~')* 'await'? atom trailer* ;
trailer = '.' name | '(' arguments? ')' | '[' slices ']' ;
slices = slice (',' slice)* ','? ;
slice = expression? ':' expression? (':' expression?)? | star_named ;
arguments = generator | (star_expression | name ':=' expression) args_a | keyword args_b | '**' expression args_c ;
args_a = (',' ((star_expression | name ':=' expression) args_a | keyword args_b | '**' expression args_c)?)? ;
args_b = (',' (keyword args_b | '*' expression args_b | '**' expression args_c)?)? ;
args_c = (',' (keyword args_c | '**' expression args_c)?)? ;
keyword = name '=' expression ;
generator = named for_if+ ;
for_if = 'async'? 'for' star_targets 'in' disjunction ('if' disjunction)* ;
atom = name | 'True' | 'False' | 'None' | NUMBER | '...' | STRING+ | BYTES+ | '(' (yield_expr | named | generator | star_named ',' (star_named (',' star_named)* ','?)?)? ')' | '[' (generator | star_named (',' star_named)* ','?)? ']' | '{' (generator | star_named (',' star_named)* ','? | expression ':' expression for_if+ | pair (',' pair)* ','?)? '}' ;
pair = expression ':' expression | '**' arithmetic ;

field = (yield_expr | star_expressions) '='? ;
"""

CPP = """
file = declaration* ;
declaration = ';' | attribute* 'namespace' attribute* (nested_names)? '{' declaration* '}' | 'inline' 'namespace' attribute* nested_names '{' declaration* '}' | 'namespace' id '=' scoped ';' | 'extern' STRING ('{' declaration* '}' | declaration) | 'template' '<' template_params? '>' declaration | 'extern'? 'template' simple_declaration | using | static_assert | asm | function | simple_declaration ;
nested_names = id ('::' 'inline'? id)* ;
using = 'using' 'namespace' scoped ';' | 'using' 'typename'? scoped '...'? (',' 'typename'? scoped '...'?)* ';' | 'using' id attribute* '=' type_id ';' ;
static_assert = 'static_assert' '(' expression (',' STRING+)? ')' ';' ;
asm = 'asm' 'volatile'? '(' STRING+ (':' asm_operands?)* ')' ';' ;
asm_operands = asm_operand (',' asm_operand)* ;
asm_operand = ('[' id ']')? STRING+ ('(' expression ')')? ;
attribute = '[' '[' balanced* ']' ']' | '__attribute__' '(' balanced* ')' | 'alignas' '(' (type_id | expression) ')' ;
balanced = id | NUMBER | STRING | TYPE | 'const' | '::' | ',' | '.' | '-' | '(' balanced* ')' ;
id = ID | FINAL ;

simple_declaration = attribute* specifiers declarators? ';' | attribute* specifier* 'auto' specifier* ('&' | '&&')? '[' id (',' id)* ']' initializer ';' ;
declarators = init_declarator (',' init_declarator)* ;
init_declarator = declarator (':' conditional)? initializer? | ':' conditional ;
initializer = '=' (assignment | braced) | '(' arguments ')' | braced | '=' ('default' | 'delete') ;
function = attribute* (specifiers declarator | specifier* special_declarator) (function_body | '=' ('default' | 'delete' | NUMBER) ';') | attribute* specifier* special_declarator ';' ;
function_body = (':' member_init (',' member_init)*)? compound | 'try' (':' member_init (',' member_init)*)? compound handler+ ;
member_init = scoped ('(' arguments? ')' | braced) '...'? ;
special_declarator = (scoped_or_destructor | conversion) parameters function_suffix* ;
scoped_or_destructor = scoped | ('::'? (part '::')*) '~' id ;
conversion = (part '::')* 'operator' type_id_short ;
specifier = 'static' | 'extern' | 'inline' | 'virtual' | 'explicit' | 'friend' | 'constexpr' | 'mutable' | 'thread_local' | 'register' | 'typedef' | 'const' | 'volatile' ;
specifiers = (specifier attribute*)* type_specifier (specifier attribute*)* ;
type_specifier = TYPE (cv* TYPE (cv* TYPE (cv* TYPE)?)?)? | 'auto' | 'typename'? scoped | 'decltype' '(' (expression | 'auto') ')' | class | enum | ('class' | 'struct' | 'union') attribute* scoped | 'enum' ('class' | 'struct')? attribute* scoped (':' TYPE+)? ;
cv = 'const' | 'volatile' ;
class = ('class' | 'struct' | 'union') attribute* (scoped FINAL?)? (':' base (',' base)*)? '{' member* '}' ;
base = attribute* ('virtual' | ACCESS)* scoped '...'? ;
member = ACCESS ':' | declaration ;
enum = 'enum' ('class' | 'struct')? attribute* scoped? (':' (specifier* type_specifier))? '{' (enumerator (',' enumerator)* ','?)? '}' ;
enumerator = id attribute* ('=' conditional)? ;

declarator = pointer* '...'? (scoped_or_destructor | conversion | '(' declarator ')') attribute* declarator_suffix* ;
pointer = ('*' | '&' | '&&') attribute* cv* | '::'? (part '::')+ '*' cv* ;
declarator_suffix = parameters function_suffix* | '[' expression? ']' ;
function_suffix = cv | '&' | '&&' | 'noexcept' ('(' expression ')')? | 'throw' '(' (type_id (',' type_id)*)? ')' | '->' type_id | FINAL | attribute ;
parameters = '(' ')' | '(' parameter (',' parameter)* (',' '...' | '...')? ')' | '(' '...' ')' ;
parameter = attribute* specifiers (declarator | abstract)? ('=' (assignment | braced))? ;
abstract = pointer+ '...'? abstract_suffix* | '...' | abstract_suffix+ ;
abstract_suffix = parameters function_suffix* | '[' expression? ']' | '(' pointer+ scoped? ')' ;
type_id = (specifier* type_specifier cv*) abstract? ;
type_id_short = specifier* type_specifier cv* pointer* ;
template_params = template_param (',' template_param)* ;
template_param = ('typename' | 'class') '...'? id? ('=' type_id)? | 'template' '<' template_params? '>' ('class' | 'typename') '...'? id? ('=' scoped)? | specifiers (declarator | abstract)? ('=' shift_free)? ;

scoped = '::'? part ('::' 'template'? part)* ;
part = id ('<' template_args? '>')? | 'operator' operator ('<' template_args? '>')? | 'decltype' '(' expression ')' ;
template_args = template_arg '...'? (',' template_arg '...'?)* ;
template_arg = type_id | shift_free | braced ;
operator = BINARY | ASSIGN | INCREMENT | '+' | '-' | '*' | '/' | '&' | '&&' | '~' | '!' | '=' | '<' | '>' | '>' '>' | '>=' | '>' '>=' | ',' | '->' | '->' '*' | '(' ')' | '[' ']' | ('new' | 'delete') ('[' ']')? | '->*' | STRING id? ;

statement = labelled | compound | ';' | attribute* expression ';' | if | 'switch' '(' condition ')' statement | 'while' '(' condition ')' statement | 'do' statement 'while' '(' expression ')' ';' | 'for' '(' (simple_declaration | expression? ';') condition? ';' expression? ')' statement | 'for' '(' (init_statement)? attribute* range_declaration ':' (expression | braced) ')' statement | 'return' (expression | braced)? ';' | ('break' | 'continue') ';' | 'goto' id ';' | 'try' compound handler+ | local_declaration | attribute+ statement ;
local_declaration = simple_declaration | using | static_assert | asm | 'namespace' id '=' scoped ';' ;
labelled = attribute* (id | 'case' conditional ('...' conditional)? | 'default') ':' statement ;
init_statement = simple_declaration | expression ';' ;
range_declaration = specifiers declarator | specifier* 'auto' specifier* ('&' | '&&')? '[' id (',' id)* ']' ;
if = 'if' 'constexpr'? '(' condition ')' statement ('else' statement)? ;
condition = init_statement? (expression | specifiers declarator ('=' (assignment | braced) | braced)) ;
compound = '{' statement* '}' ;
handler = 'catch' '(' (attribute* specifiers (declarator | abstract)? | '...') ')' compound ;

expression = assignment (',' assignment)* ;
assignment = conditional ((ASSIGN | '=' | '>' '>=') (assignment | braced))? | 'throw' assignment? ;
conditional = binary ('?' expression ':' assignment)? ;
binary = unary ((BINARY | '*' | '&' | '&&' | '+' | '-' | '/' | '<' | '>' | '>' '>' | '>=' | '->*') unary)* ;
shift_free = sf_binary ('?' expression ':' sf_binary)? ;
sf_binary = unary ((BINARY | '*' | '&' | '&&' | '+' | '-' | '/' | '<' | '>=') unary)* ;
unary = ('+' | '-' | '*' | '&' | '&&' | '!' | '~' | INCREMENT)* unary_end ;
unary_end = postfix | 'sizeof' (unary | '(' type_id ')' | '...' '(' id ')') | 'alignof' '(' type_id ')' | 'noexcept' '(' expression ')' | '(' type_id ')' (unary | braced) | '::'? 'new' ('(' arguments ')')? (new_type | '(' type_id ')') ('(' arguments? ')' | braced)? | '::'? 'delete' ('[' ']')? unary ;
new_type = specifier* type_specifier cv* pointer* ('[' expression? ']')* ;
postfix = primary postfix_suffix* ;
postfix_suffix = '[' (expression | braced) ']' | '(' arguments? ')' | ('.' | '->') ('template'? scoped | '~' part | scoped '::' '~' id | conversion) | INCREMENT ;
primary = NUMBER | CHAR | STRING+ | 'this' | 'nullptr' | 'true' | 'false' | '(' expression ')' | '(' fold ')' | scoped braced? | TYPE+ ('(' arguments? ')' | braced) | 'auto' ('(' arguments? ')' | braced) | 'typename' scoped ('(' arguments? ')' | braced) | CAST '<' type_id '>' '(' expression ')' | 'typeid' '(' (type_id | expression) ')' | lambda ;
fold = unary fold_op '...' | '...' fold_op unary | unary fold_op '...' fold_op unary ;
fold_op = BINARY | '*' | '&' | '&&' | '+' | '-' | '/' | '<' | '>' | '>' '>' | ',' | '=' | ASSIGN ;
arguments = argument (',' argument)* ;
argument = (assignment | braced) '...'? ;
braced = '{' (element (',' element)* ','?)? '}' ;
element = ('.' id ('=' (assignment | braced) | braced) | assignment | braced) '...'? ;
lambda = '[' captures? ']' ('<' template_params '>')? (parameters lambda_suffix*)? compound ;
lambda_suffix = 'mutable' | 'constexpr' | 'noexcept' ('(' expression ')')? | '->' type_id | attribute ;
captures = capture (',' capture)* ;
capture = '=' | '&' | '&'? '...'? id '...'? initializer? | '*'? 'this' ;
"""


def _kinds(rules: str, words: dict[str, list[str]]) -> dict[str, int]:
    """A byte for every quoted token and class; 10 and 0 are left free. ``words`` adds spellings to classes."""
    names = list(dict.fromkeys(re.findall(r"'([^']+)'|\b([A-Z]{2,})\b", rules)))
    kinds: dict[str, int] = {}
    free = [b for b in range(1, 256) if b != 10]
    for quoted, class_ in names:
        name = quoted or class_
        if name not in kinds:
            kinds[name] = 10 if name == "NEWLINE" else free.pop(0)
    for class_, spellings in words.items():
        for word in spellings:
            kinds.setdefault(word, kinds[class_])
    kinds["ERROR"] = free.pop(0)
    return kinds


PYTHON_KINDS = _kinds(PYTHON, {
    "AUGMENT": "+= -= *= /= //= %= @= &= |= ^= <<= >>= **=".split(),
    "COMPARE": "== != <= >=".split(),
    "BINARY": "% // << >> & ^".split(),
})
CPP_KINDS = _kinds(CPP, {
    "TYPE": "void bool char short int long float double signed unsigned wchar_t char16_t char32_t char8_t __int128".split(),
    "ACCESS": "public private protected".split(),
    "BINARY": "% | || ^ == != <= << and or xor bitor bitand not_eq .* <=>".split(),
    "ASSIGN": "+= -= *= /= %= &= |= ^= <<= and_eq or_eq xor_eq".split(),
    "INCREMENT": "++ --".split(),
    "CAST": "static_cast dynamic_cast const_cast reinterpret_cast".split(),
})
