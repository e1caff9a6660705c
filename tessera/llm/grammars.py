"""Grammars of the supported languages, as data for `gll`. Reserved words and operators are fixed values of the languages."""

from __future__ import annotations

PYTHON_RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"

#: A line of Python; `Ind` groups are indented blocks, whose tokens are lines.
PYTHON = """
Line = Small (';' Small)* ';'? ;
Small = Assign | Star | 'pass' | 'break' | 'continue' | 'return' Star? | 'raise' (Expr ('from' Expr)?)? | 'global' Names | 'nonlocal' Names
  | 'del' DelTarget (',' DelTarget)* ','? | 'assert' Expr (',' Expr)? | 'import' Dotted ('as' ID)? (',' Dotted ('as' ID)?)*
  | 'from' ('.' | '...')* Dotted 'import' Imported | 'from' ('.' | '...')+ 'import' Imported | Yield | 'type' ID @[TypeParams]? '=' Expr ;
Imported = '*' | ImportNames | @(ImportList) ;
ImportNames = ID ('as' ID)? (',' ID ('as' ID)?)* ;
ImportList = ImportNames ','? ;
Names = ID (',' ID)* ;
Dotted = ID ('.' ID)* ;
Assign = (Targets '=')+ (Star | Yield) | OneTarget AugOp (Star | Yield) | OneTarget ':' Expr ('=' (Star | Yield))? ;
OneTarget = ID | Primary '.' ID | Primary @[Index] | @(OneTarget) ;
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
Targets = SElem (',' SElem)* ','? ;
SElem = '*'? Target ;
Target = ID | Primary '.' ID | Primary @[Index] | @(TargetGroup) | @[TargetList] ;
TargetGroup = Targets? ;
TargetList = Targets? ;
DelTarget = ID | Primary '.' ID | Primary @[Index] | @(TargetGroup) | @[TargetList] ;
Yield = 'yield' ('from' Expr | Star?) ;
Star = StarOne (',' StarOne)* ','? ;
StarOne = '*' Bit | Expr ;
StarNamed = StarItem (',' StarItem)* ','? ;
StarItem = '*' Bit | Named ;
OneOrMore = Named | StarItem ',' (StarItem (',' StarItem)* ','?)? ;
Named = (ID ':=')? Expr ;
Expr = Or ('if' Or 'else' Expr)? | 'lambda' LParams ':' Expr ;
Or = Not (('and' | 'or') Not)* ;
Not = 'not' Not | Bit (CompOp Bit)* ;
CompOp = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
Bit = Unary (BinOp Unary)* ;
BinOp = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
Unary = ('+' | '-' | '~~')* 'await'? Primary ;
Primary = Atom Trailer* ;
Trailer = '.' ID | @(Args) | @[Index] ;
Atom = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | @(Paren) | @[ListBody] | @{DictBody} ;
Paren = (OneOrMore | Yield | Comp)? ;
ListBody = (StarNamed | Comp)? ;
Comp = Named CompFor ;
CompFor = ('async'? 'for' Targets 'in' Or ('if' Or)*)+ ;
DictBody = (Item (',' Item)* ','? | StarNamed | Comp | Expr ':' Expr CompFor)? ;
Item = Expr ':' Expr | '**' Bit ;
Args = (PosArgs (',' KeyArgs)? ','? | KeyArgs ','? | Comp)? ;
PosArgs = PosArg (',' PosArg)* ;
PosArg = Named | '*' Expr ;
KeyArgs = KeyOrStar (',' KeyOrStar)* (',' KeyOrMap)* | KeyOrMap (',' KeyOrMap)* ;
KeyOrStar = ID '=' Expr | '*' Expr ;
KeyOrMap = ID '=' Expr | '**' Expr ;
Index = Slice (',' Slice)* ','? ;
Slice = Named | '*' Bit | Expr? ':' Expr? (':' Expr?)? ;
LParams = (LFront (',' LBack)? ','? | LBack ','?)? ;
LFront = LSet | LBare (',' LBare)* ',' '/' (',' LSet)? | (LBare ',')* LDefault (',' LDefault)* ',' '/' (',' LDefault)* ;
LSet = LBare (',' LBare)* (',' LDefault)* | LDefault (',' LDefault)* ;
LBare = ID ;
LDefault = ID '=' Expr ;
LBack = '*' ID (',' (LBare | LDefault))* (',' '**' ID)? | '*' (',' (LBare | LDefault))+ (',' '**' ID)? | '**' ID ;
Params = (Front (',' Back)? ','? | Back ','?)? ;
Front = ParamSet | Bare (',' Bare)* ',' '/' (',' ParamSet)? | (Bare ',')* Default (',' Default)* ',' '/' (',' Default)* ;
ParamSet = Bare (',' Bare)* (',' Default)* | Default (',' Default)* ;
Bare = ID (':' Expr)? ;
Default = ID (':' Expr)? '=' Expr ;
Back = '*' ID (':' '*'? Expr)? (',' (Bare | Default))* (',' '**' ID (':' Expr)?)? | '*' (',' (Bare | Default))+ (',' '**' ID (':' Expr)?)? | '**' ID (':' Expr)? ;
TypeParams = TypeParam (',' TypeParam)* ','? ;
TypeParam = ('*' | '**')? ID (':' Expr)? ('=' Expr)? ;
IfHead = 'if' Named ':' ;
ElifHead = 'elif' Named ':' ;
ElseHead = 'else' ':' ;
WhileHead = 'while' Named ':' ;
ForHead = 'async'? 'for' Targets 'in' Star ':' ;
TryHead = 'try' ':' ;
ExceptHead = 'except' (Expr ('as' ID)?)? ':' ;
GroupHead = 'except' '*' Expr ('as' ID)? ':' ;
FinallyHead = 'finally' ':' ;
WithHead = 'async'? 'with' (WithItem (',' WithItem)* | @(WithItems)) ':' ;
WithItems = WithItem (',' WithItem)* ','? ;
WithItem = Expr ('as' '*'? Target)? ;
DefHead = 'async'? 'def' ID @[TypeParams]? @(Params) ('->' Expr)? ':' ;
ClassHead = 'class' ID @[TypeParams]? @(Args)? ':' ;
Decorator = '@' Named ;
MatchHead = 'match' OneOrMore ':' ;
CaseHead = 'case' Patterns ('if' Named)? ':' ;
Patterns = Pattern (',' Pattern)* ','? ;
Pattern = ('*' ID | Closed ('|' Closed)*) ('as' ID)? ;
Closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | ID ('.' ID)* (@(PatArgs))? | @(PatGroup) | @[PatGroup] | @{PatMap} ;
PatGroup = Patterns? ;
PatArgs = (PatArg (',' PatArg)* ','?)? ;
PatArg = (ID '=')? Pattern ;
PatMap = (PatItem (',' PatItem)* ','?)? ;
PatItem = Closed ':' Pattern | '**' ID ;
"""
#: Kinds of lines, in this order as bits, and how lines and blocks make statements. A head with its body on the line ends in `1`.
PYTHON_LINES = "Line IfHead ElifHead ElseHead WhileHead ForHead TryHead ExceptHead GroupHead FinallyHead WithHead DefHead ClassHead Decorator MatchHead CaseHead".split()
PYTHON_BLOCKS = """
Block = Stmt+ ;
Stmt = Line | If | While | For | Try | With | Def | Match ;
Body = @#Block# ;
If = (IfHead Body | IfHead1) (ElifHead Body | ElifHead1)* Else? ;
Else = ElseHead Body | ElseHead1 ;
While = (WhileHead Body | WhileHead1) Else? ;
For = (ForHead Body | ForHead1) Else? ;
Finally = FinallyHead Body | FinallyHead1 ;
Except = ExceptHead Body | ExceptHead1 ;
Group = GroupHead Body | GroupHead1 ;
Try = (TryHead Body | TryHead1) ((Except+ | Group+) Else? Finally? | Finally) ;
With = WithHead Body | WithHead1 ;
Def = Decorator* (DefHead Body | DefHead1 | ClassHead Body | ClassHead1) ;
Match = MatchHead @#Cases# ;
Cases = (CaseHead Body | CaseHead1)+ ;
"""

JAVA_RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"

JAVA = """
File = (Annot* 'package' QName ';')? Import* TypeDecl* | Import* Annot* 'open'? 'module' QName @{Module} ;
Module = (('requires' ('transitive' | 'static')* QName | ('exports' | 'opens') QName ('to' QName (',' QName)*)? | 'uses' QName | 'provides' QName 'with' QName (',' QName)*) ';')* ;
Import = 'import' 'static'? QName ('.' '*')? ';' | ';' ;
QName = ID ('.' ID)* ;
TypeDecl = Mod* TypeKind | ';' ;
TypeKind = Class | Interface | Enum | Record | AnnType ;
Mod = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' | Annot ;
Annot = '@' QName @(AnnArgs)? ;
AnnArgs = (AnnVal | ID '=' AnnVal (',' ID '=' AnnVal)*)? ;
AnnVal = Tern | Annot | @{AnnArray} ;
AnnArray = (AnnVal (',' AnnVal)*)? ','? ;
Class = 'class' ID TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? @{ClassBody} ;
Interface = 'interface' ID TParams? ('extends' Types)? ('permits' Types)? @{ClassBody} ;
AnnType = '@' 'interface' ID @{ClassBody} ;
Enum = 'enum' ID ('implements' Types)? @{EnumBody} ;
Record = 'record' ID TParams? @(Params) ('implements' Types)? @{ClassBody} ;
EnumBody = (Constant (',' Constant)*)? ','? (';' Member*)? ;
Constant = Annot* ID @(Args)? @{ClassBody}? ;
Types = Type (',' Type)* ;
ClassBody = Member* ;
Member = ';' | 'static'? @{Block} | Mod* MemberDecl ;
MemberDecl = TypeKind | TParams? (Type | 'void') ID @(Params) Dims ('throws' Types)? MBody | TParams? ID @(Params) ('throws' Types)? @{Block} | ID @{Block} | Type Declarators ';' ;
MBody = @{Block} | ';' | 'default' AnnVal ';' ;
Declarators = Declarator (',' Declarator)* ;
Declarator = ID Dims ('=' VarInit)? ;
VarInit = Expr | @{ArrayInit} ;
ArrayInit = (VarInit (',' VarInit)*)? ','? ;
Dims = (Annot* @[Empty])* ;
Empty = ;
Prim = 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short' ;
Type = Annot* (Prim | ClassType) Dims ;
ClassType = ID TArgs? ('.' Annot* ID TArgs?)* ;
TArgs = '<' (TArg (',' TArg)*)? '>' ;
TArg = Annot* '?' (('extends' | 'super') Type)? | Type ;
TParams = '<' TParam (',' TParam)* '>' ;
TParam = Annot* ID ('extends' Type ('&' Type)*)? ;
Params = (Param (',' Param)*)? ;
Param = PMod* Type (Annot* '...')? (ID Dims | (ID '.')* 'this') ;
PMod = 'final' | Annot ;
Block = Stmt* ;
Stmt = @{Block} | ';' | PMod* Type Declarators ';' | Mod* TypeKind | ID ':' Stmt | 'if' @(Expr) Stmt ('else' Stmt)? | 'while' @(Expr) Stmt
  | 'do' Stmt 'while' @(Expr) ';' | 'for' @(ForParts) Stmt | 'switch' @(Expr) @{SwitchBody} | 'return' Expr? ';' | 'throw' Expr ';' | 'break' ID? ';'
  | 'continue' ID? ';' | 'yield' Expr ';' | 'try' @{Block} (Catch+ Finally? | Finally) | 'try' @(Resources) @{Block} Catch* Finally?
  | 'synchronized' @(Expr) @{Block} | 'assert' Expr (':' Expr)? ';' | ExprStmt ';' | 'this' @(Args) ';' | (Primary '.')? 'super' @(Args) ';' ;
Catch = 'catch' @(CatchHead) @{Block} ;
Finally = 'finally' @{Block} ;
CatchHead = PMod* Type ('|' Type)* ID ;
Resources = Resource (';' Resource)* ';'? ;
Resource = PMod* Type ID '=' Expr | Primary ;
ForParts = ForInit? ';' Expr? ';' (ExprStmt (',' ExprStmt)*)? | PMod* Type ID Dims ':' Expr ;
ForInit = PMod* Type Declarators | ExprStmt (',' ExprStmt)* ;
ExprStmt = Unary AssignOp Expr | ('++' | '--') Unary | Postfix ('++' | '--') | Called ;
Called = Primary @(Args) | (Primary '.')? 'new' Creator | Atom @(Args) ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
SwitchBody = (Label+ ':' Stmt* | Case ':' Stmt* | Case '->' (Expr ';' | @{Block} | 'throw' Expr ';'))* ;
Label = Case ':' ;
Case = 'default' | 'case' CaseItem (',' CaseItem)* ('when' Expr)? ;
CaseItem = Tern | 'default' | PMod* Type ID | RecPattern ;
RecPattern = Type @(RecParts) ID? ;
RecParts = (RecPart (',' RecPart)*)? ;
RecPart = PMod* Type ID | RecPattern ;
Expr = Lambda | Tern (AssignOp Expr)? ;
Tern = Bin ('?' Expr ':' (Lambda | Tern))? ;
Bin = Unary (BinOp Unary | 'instanceof' PMod* (Type ID? | RecPattern))* ;
BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' ;
Unary = ('+' | '-' | '!' | '~~' | '++' | '--') Unary | @(CastType) (Unary | Lambda) | Postfix | 'switch' @(Expr) @{SwitchBody} ;
CastType = Type ('&' Type)* ;
Postfix = Primary ('++' | '--')* ;
Primary = Atom Suffix* ;
Atom = ID | LIT | 'this' | 'super' | @(Expr) | 'new' Creator | (Prim | 'void') Dims '.' 'class' | QName DimsOne '.' 'class' | Type '::' ('new' | ID) ;
DimsOne = @[Empty]+ ;
LIT = NUM | STR | 'true' | 'false' | 'null' ;
Suffix = '.' TArgs? ID | '.' ('class' | 'this' | 'super') | '.' 'new' Creator | @(Args) | @[Expr] | '::' TArgs? (ID | 'new') ;
Creator = TArgs? Annot* ClassType @(Args) @{ClassBody}? | Annot* (Prim | ClassType) @[Expr]+ Dims | Annot* (Prim | ClassType) DimsOne @{ArrayInit} ;
Args = (Expr (',' Expr)*)? ;
Lambda = (ID | @(Params) | @(Ids)) '->' (Expr | @{Block}) ;
Ids = ID (',' ID)* ;
"""

CSHARP_RESERVED = "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"

CSHARP = """
File = ('extern' 'alias' ID ';')* Using* Attrs* Unit* ;
Unit = Namespace | Using | Attrs | Mod* TypeDecl | TopStmt ;
TopStmt = Stmt ;
Using = 'global'? 'using' ('static' | 'unsafe')? ((ID '=')? Type) ';' ;
Namespace = 'namespace' QName (@{NsBody} ';'? | ';') ;
NsBody = (Using | Namespace | Mod* TypeDecl)* ;
QName = ID (('.' | '::') ID)* ;
Attrs = @[AttrList] ;
AttrList = ((ID | 'event' | 'return') ':')? Attr (',' Attr)* ','? ;
Attr = ClassType @(AttrArgs)? ;
AttrArgs = (AttrArg (',' AttrArg)*)? ;
AttrArg = (ID ('=' | ':'))? Expr ;
Mod = Attrs | 'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'partial' | 'async' | 'const' | 'required' | 'ref' | 'file' ;
TypeDecl = ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) ID TParams? @(Params)? (':' Bases)? Where* (@{ClassBody} ';'? | ';')
  | 'enum' ID (':' Type)? @{EnumBody} ';'? | 'delegate' (Type | 'void') ID TParams? @(Params) Where* ';' ;
Bases = Base (',' Base)* ;
Base = Type @(Args)? ;
Where = 'where' ID ':' Constraint (',' Constraint)* ;
Constraint = 'class' '?'? | 'struct' | 'new' @(Empty) | 'default' | 'notnull' | 'unmanaged' | Type ;
EnumBody = (EnumItem (',' EnumItem)*)? ','? ;
EnumItem = Attrs* ID ('=' Expr)? ;
ClassBody = Member* ;
Member = Mod* (TypeDecl | Field | Method | Property | Ctor | Operator | 'event' Type (ID (',' ID)* ';' | Name @{Accessors}) | 'fixed' Type ID @[Expr] ';') ;
Field = Type Declarators ';' ;
Declarators = Declarator (',' Declarator)* ;
Declarator = ID ('=' VarInit)? ;
VarInit = Expr | @{ArrayInit} | 'ref' Expr | 'stackalloc' Type @[Expr] ;
ArrayInit = (VarInit (',' VarInit)*)? ','? ;
Name = (ClassType '.')? ID ;
Method = (Type | 'void') Name TParams? @(Params) Where* MBody ;
MBody = @{Block} | '=>' ArrowBody ';' | ';' ;
ArrowBody = Expr | 'throw' Expr | 'ref' Expr ;
Property = Type (Name | (ClassType '.')? 'this' @[IndexParams]) (@{Accessors} ('=' VarInit ';')? | '=>' ArrowBody ';') ;
IndexParams = Params ;
Accessors = (AccMod* ('get' | 'set' | 'init' | 'add' | 'remove') MBody)+ ;
AccMod = Attrs | 'public' | 'private' | 'protected' | 'internal' | 'readonly' ;
Ctor = '~~'? ID @(Params) (':' ('base' | 'this') @(Args))? MBody ;
Operator = (Type | ('implicit' | 'explicit')) 'operator' (OpSign | Type) @(Params) MBody ;
OpSign = '+' | '-' | '*' | '/' | '%' | '!' | '~~' | '++' | '--' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | 'true' | 'false' ;
Prim = 'int' | 'long' | 'double' | 'float' | 'bool' | 'char' | 'byte' | 'short' | 'string' | 'object' | 'decimal' | 'uint' | 'ulong' | 'ushort' | 'sbyte' ;
Type = ('ref' 'readonly'?)? (Prim | ClassType | @(TupleType) | 'void' '*') TSuffix* | 'delegate' '*' TArgs ;
TSuffix = '?' | '*' | @[Rank] ;
Rank = ','* ;
TupleType = TupleItem (',' TupleItem)+ ;
TupleItem = Type ID? ;
ClassType = (ID '::')? ID TArgs? ('.' ID TArgs?)* ;
TArgs = '<' (Type (',' Type)* | ','*) '>' ;
TParams = '<' TParam (',' TParam)* '>' ;
TParam = Attrs* ('in' | 'out')? ID ;
Params = (Param (',' Param)*)? ;
Param = Attrs* ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* Type ID ('=' Expr)? | '__arglist' ;
Empty = ;
Block = Stmt* ;
Stmt = @{Block} | ';' | LocalDecl ';' | LocalFunc | ID ':' Stmt | 'if' @(Expr) Stmt ('else' Stmt)? | 'while' @(Expr) Stmt | 'do' Stmt 'while' @(Expr) ';'
  | 'for' @(ForParts) Stmt | 'await'? 'foreach' @(EachHead) Stmt | 'switch' @(Expr) @{SwitchBody} | 'return' ('ref'? Expr)? ';' | 'throw' Expr? ';' | 'break' ';' | 'continue' ';'
  | 'goto' (ID | 'case' Expr | 'default') ';' | 'yield' ('return' Expr | 'break') ';' | 'try' @{Block} (Catch+ Finally? | Finally) | 'lock' @(Expr) Stmt
  | 'await'? 'using' (@(UsingHead) Stmt | LocalDecl ';') | ('checked' | 'unchecked' | 'unsafe') @{Block} | 'fixed' @(UsingHead) Stmt | ExprStmt ';' ;
LocalDecl = ('const' | 'scoped')? Type Declarators | 'const' Type Declarators ;
LocalFunc = (Attrs | 'static' | 'async' | 'unsafe' | 'extern')* (Type | 'void') ID TParams? @(Params) Where* MBody ;
Catch = 'catch' @(CatchHead)? ('when' @(Expr))? @{Block} ;
CatchHead = Type ID? ;
Finally = 'finally' @{Block} ;
UsingHead = LocalDecl | Expr ;
ForParts = ForInit? ';' Expr? ';' (ExprStmt (',' ExprStmt)*)? ;
ForInit = LocalDecl | ExprStmt (',' ExprStmt)* ;
EachHead = ('ref' 'readonly'?)? (Type ID | 'var'? @(Designation)) 'in' Expr ;
Designation = Designated (',' Designated)+ ;
Designated = ID | Type ID | @(Designation) ;
ExprStmt = Unary AssignOp Expr | ('++' | '--') Unary | Primary ('++' | '--') | Called | 'await' Unary ;
Called = Primary @(Args) | Atom @(Args) | 'new' Creator ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '??=' ;
SwitchBody = (Label+ Stmt+)* ;
Label = ('case' Pattern ('when' Expr)? | 'default') ':' ;
Expr = Lambda | Query | 'throw' Expr | Tern (AssignOp Expr)? | 'ref' Expr ;
Tern = Bin ('?' Expr ':' Expr)? ;
Bin = Unary (BinOp Unary | 'is' Pattern | 'as' Type | 'switch' @{SwitchExpr} | 'with' @{Init} | '..' Unary? | '??' 'throw' Expr | BinOp Lambda)* ;
BinOp = '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' ;
SwitchExpr = (Arm (',' Arm)*)? ','? ;
Arm = Pattern ('when' Expr)? '=>' Expr ;
Pattern = PatAnd ('or' PatAnd)* ;
PatAnd = PatNot ('and' PatNot)* ;
PatNot = 'not'* PatOne ;
PatOne = Type ID? | 'var' (ID | @(Designation)) | ('<' | '>' | '<=' | '>=') Shift | Shift | Type? @(PatList) (@{PatProps})? ID? | Type? @{PatProps} ID? | @(Pattern) | @[PatItems] ;
Shift = Unary (BinOp Unary)* ;
PatList = (PatItem (',' PatItem)*)? ;
PatItem = (ID ':')? Pattern ;
PatItems = ((Pattern | '..' Pattern?) (',' (Pattern | '..' Pattern?))*)? ;
PatProps = (QName ':' Pattern (',' QName ':' Pattern)*)? ','? ;
Unary = ('+' | '-' | '!' | '~~' | '++' | '--' | 'await' | '^' | '&' | '*') Unary | @(CastType) (Unary | Lambda) | Primary ('++' | '--' | '!')* | '..' Unary? ;
CastType = Type ;
Primary = Atom Suffix* ;
Atom = ID | LIT | 'this' | 'base' | Prim | @(Expr) | @(TupleExpr) | 'new' Creator | 'typeof' @(TypeOf) | 'sizeof' @(CastType) | 'nameof' @(Expr) | 'default' (@(CastType))?
  | ('checked' | 'unchecked') @(Expr) | ID TArgs | ID '::' ID | @[Elements] | 'stackalloc' Type? @[Expr] @{ArrayInit}? | 'delegate' @(Params)? @{Block} | 'async' 'delegate' @(Params)? @{Block} ;
TypeOf = Type | 'void' ;
TupleExpr = Arg (',' Arg)+ ;
Elements = ((Expr | '..' Expr) (',' (Expr | '..' Expr))*)? ','? ;
LIT = NUM | STR | 'true' | 'false' | 'null' ;
Suffix = '.' ID TArgs? | '?' '.' ID TArgs? | '->' ID | @(Args) | @[Args] | '?' @[Args] | '!' ;
Creator = Type (@(Args) @{Init}? | @{Init}) | @(Args) @{Init}? | @{Init} | Type? @[Rank] @{ArrayInit} | (Prim | ClassType) @[Args] TSuffix* @{ArrayInit}? ;
Init = (InitItem (',' InitItem)*)? ','? ;
InitItem = (ID | @[Args]) '=' (Expr | @{Init}) | Expr | @{ArrayInit} ;
Args = (Arg (',' Arg)*)? ;
Arg = (ID ':')? ('ref' Expr | 'in' Expr | 'out' (Expr | Type ID) | Expr | Type ID) ;
Lambda = (Attrs | 'async' | 'static')* Type? (ID | @(LParams) | @(Params)) '=>' (Expr | @{Block}) ;
LParams = (LParam (',' LParam)*)? ;
LParam = ('ref' | 'out' | 'in')? ID ;
Query = From Clause* ('select' Expr | 'group' Expr 'by' Expr) ('into' ID Clause* ('select' Expr | 'group' Expr 'by' Expr))* ;
From = 'from' Type? ID 'in' Expr ;
Clause = From | 'let' ID '=' Expr | 'where' Expr | 'join' Type? ID 'in' Expr 'on' Expr 'equals' Expr ('into' ID)? | 'orderby' Ordering (',' Ordering)* ;
Ordering = Expr ('ascending' | 'descending')? ;
"""

TYPESCRIPT_RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"

#: TypeScript, JavaScript, the declarations of both, and the elements of their dialect with markup; `~` is a line end that ends a statement.
#: Kinds that begin with `<` or end with `>` come from the lexer of that dialect alone.
TYPESCRIPT = """
File = Block ;
Block = Stmt* ;
End = ';' | ~ ;
Stmt = @{Block} | ';' | VarDecl End | Func | Class | 'if' @(Expr) Stmt ('else' Stmt)? | 'while' @(Expr) Stmt | 'do' Stmt 'while' @(Expr) ';'?
  | 'for' 'await'? @(ForParts) Stmt | 'switch' @(Expr) @{SwitchBody} | 'return' Expr? End | 'throw' Expr End | 'break' ID? End | 'continue' ID? End
  | 'try' @{Block} (Catch Finally? | Finally) | ID ':' Stmt | 'debugger' End | 'with' @(Expr) Stmt | ExprStmt End | Import | Export | Declared | 'declare' (VarDecl End | Func | Class | Declared | 'global' @{Block} | 'module' STR (@{Block} | End)) ;
Declared = 'type' ID TParams? '=' Type End | 'interface' ID TParams? ('extends' Type (',' Type)*)? @{TypeBody} | 'const'? 'enum' ID @{EnumBody} | ('namespace' | 'module') (Dotted | STR) @{Block} | 'abstract' Class ;
Dotted = ID ('.' ID)* ;
Catch = 'catch' @(CatchHead)? @{Block} ;
CatchHead = Binding (':' Type)? ;
Finally = 'finally' @{Block} ;
VarDecl = ('var' | 'let' | 'const' | 'using' | 'await' 'using') Declarator (',' Declarator)* ;
Declarator = Binding '!'? (':' Type)? ('=' Assign)? ;
Binding = ID | @{ObjPattern} | @[ArrPattern] ;
ObjPattern = (PatProp (',' PatProp)*)? ','? ;
PatProp = ID ('=' Assign)? | PropName ':' Binding ('=' Assign)? | '...' Binding ;
ArrPattern = (PatItem? ','?)* ;
PatItem = '...'? Binding ('=' Assign)? ;
ForParts = (VarDecl | Expr)? ';' Expr? ';' Expr? | (('var' | 'let' | 'const') Binding (':' Type)? | Unary) ('of' | 'in') Expr ;
SwitchBody = (('case' Expr | 'default') ':' Stmt*)* ;
Func = 'async'? 'function' '*'? ID TParams? @(Params) (':' Type)? (@{Block} | End) ;
Params = (Param (',' Param)*)? ','? ;
Param = Deco* ('public' | 'private' | 'protected' | 'readonly' | 'override')* '...'? (Binding | 'this') '?'? (':' Type)? ('=' Assign)? ;
Deco = '@' Primary ;
Class = Deco* 'abstract'? 'class' ID? TParams? ('extends' Primary TArgs?)? ('implements' Type (',' Type)*)? @{ClassBody} ;
ClassBody = Member* ;
Member = ';' | CMod* MemberRest ;
CMod = Deco | 'public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async' | 'get' | 'set' | 'accessor' | '*' ;
MemberRest = PropName '?'? TParams? @(Params) (':' Type)? (@{Block} | End) | PropName ('?' | '!')? (':' Type)? ('=' Assign)? End | 'static' @{Block} | @[IndexSig] ':' Type End ;
PropName = ID | Word | STR | NUM | @[Computed] | '#' ID ;
Computed = Assign ;
IndexSig = ID ':' Type | ID 'in' Type ('as' Type)? ;
Import = 'import' 'type'? (STR | ImportWhat 'from' STR) ('with' @{ObjLit})? End | 'import' ID '=' (Dotted | 'require' @(Args)) End ;
ImportWhat = ID | (ID ',')? ('*' 'as' ID | @{Names}) ;
Names = (Named (',' Named)*)? ','? ;
Named = 'type'? (ID | Word | STR) ('as' (ID | Word | STR))? ;
Export = Deco* 'export' (VarDecl End | Func | Class | Declared | 'declare' (VarDecl End | Func | Class | Declared) | 'default' (Func | 'async'? 'function' '*'? @(Params) (':' Type)? @{Block} | Class | 'abstract' Class | Assign End | Declared) | 'type'? ('*' ('as' ID)? | @{Names}) ('from' STR)? End | '=' Expr End | 'as' 'namespace' ID End) ;
EnumBody = (EnumItem (',' EnumItem)*)? ','? ;
EnumItem = (ID | STR) ('=' Assign)? ;
Type = FnType | UType ('extends' UType '?' Type ':' Type)? ;
FnType = ('abstract'? 'new')? TParams? @(Params) '=>' Type ;
UType = ('|' | '&')? PType (('|' | '&') PType)* ;
PType = ('keyof' | 'readonly' | 'unique' | 'infer')* TAtom (@[Empty] | @[IndexType])* ;
Empty = ;
IndexType = Type ;
TAtom = Dotted TArgs? | LIT | '-' NUM | @(TypeGroup) | @[Tuple] | @{TypeBody} | 'this' | 'void' | 'typeof' Dotted TArgs? | 'typeof'? 'import' @(Args) ('.' ID)* TArgs? | (ID | 'this') 'is' Type | 'asserts' (ID | 'this') ('is' Type)? | 'infer' ID ('extends' Type)? ;
TypeGroup = Type ;
Tuple = (TupleItem (',' TupleItem)*)? ','? ;
TupleItem = '...'? (ID '?'? ':')? Type '?'? ;
TypeBody = (TMember (';' | ',' | ~))* TMember? ;
TMember = ('readonly' | '+' | '-' | 'get' | 'set' | 'static')* (PropName '?'? (':' Type)? | PropName? '?'? TParams? @(Params) (':' Type)? | 'new' TParams? @(Params) (':' Type)? | @[IndexSig] ('+' | '-')? '?'? (':' Type)?) ;
TArgs = '<' Type (',' Type)* '>' ;
TParams = '<' TParam (',' TParam)* ','? '>' ;
TParam = ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)? ;
ExprStmt = Expr ;
Expr = Assign (',' Assign)* ;
Assign = Arrow | 'yield' '*'? Assign? | Tern (AssignOp Assign)? ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '**=' | '??=' | '||=' | '&&=' ;
Arrow = 'async'? (ID | TParams? @(Params) (':' Type)?) '=>' (@{Block} | Assign) ;
Tern = Bin ('?' Assign ':' Assign)? ;
Bin = Unary (BinOp Unary | ('as' | 'satisfies') ('const' | Type))* ;
BinOp = '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '**' | 'in' | 'instanceof' ;
Unary = ('+' | '-' | '!' | '~~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await') Unary | TArgs Unary | Primary ('++' | '--')? ;
Primary = Atom Suffix* ;
Atom = ID | LIT | 'this' | 'super' | @(Group) | @[Elements] | @{ObjLit} | 'new' NewTail | 'async'? 'function' '*'? ID? TParams? @(Params) (':' Type)? @{Block} | Class | 'import' (@(Args) | '.' ID) | '#' ID | @#Element# ;
Element = '<tag' Attr* ('/>' | '<open' Child* '</tag') | '<frag' Child* '</tag' ;
Attr = '<name' ('=' ('<str' | @{Embedded} | @#Element#))? | @{Spread} ;
Child = '<text' | @{Filling} | @#Element# ;
Embedded = Expr ;
Spread = '...' Assign ;
Filling = ('...'? Expr)? ;
NewTail = 'new' NewTail | '.' ID | Atom NewSuffix* TArgs? @(Args)? ;
NewSuffix = '.' (ID | Word | '#' ID) | @[Index] | '!' ;
Group = Expr ;
Index = Expr ;
LIT = NUM | STR | 'true' | 'false' | 'null' ;
Suffix = '.' (ID | Word | '#' ID) | '?.' (ID | Word | @(Args) | @[Index] | '#' ID) | TArgs? @(Args) | @[Index] | '!' | STR ;
Args = (Arg (',' Arg)*)? ','? ;
Arg = '...'? Assign ;
Elements = ('...'? Assign? ','?)* ;
ObjLit = (Prop (',' Prop)*)? ','? ;
Prop = ID ('=' Assign)? | PropName ':' Assign | '...' Assign | ('async' | 'get' | 'set' | '*')* PropName TParams? @(Params) (':' Type)? @{Block} ;
Word = 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' ;
"""
