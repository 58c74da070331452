"""Patterns that name language features in source text."""

# Results are counts of just these patterns.

ANY_PATTERN = (r':\s*any[\s,;>\)\|&]|<any>|as\s+any|\|\s*any|&\s*any|'
               r'Array<any>|Promise<any>|Record<\w+,\s*any>|Record<any')
DYNAMIC_PATTERN = r'\bdynamic\s+\w+|\bdynamic\>|:\s*dynamic\b|<dynamic>'
UNSAFE_PATTERN = r'\bunsafe\b'

TS_FEATURES = {
    'generics': r'<[A-Z]\w*(?:\s+extends\s+[^>]+)?(?:,\s*[A-Z]\w*(?:\s+extends\s+[^>]+)?)*>',
    'conditional_types': r'\s+extends\s+.*\s+\?\s+.*\s+:\s+',
    'mapped_types': r'\[\s*(?:K|P|T)\s+in\s+(?:keyof\s+)?[^\]]+\]',
    'template_literals': r'`[^`]*\$\{[^}]+\}[^`]*`',
    'utility_types': r'\b(?:Partial|Required|Readonly|Record|Pick|Omit|Exclude|Extract|NonNullable|Parameters|ConstructorParameters|ReturnType|InstanceType)\s*<',
    'type_guards': r'\b(?:is|asserts)\s+\w+',
    'satisfies': r'\bsatisfies\s+',
    'as_const': r'\bas\s+const\b',
    'non_null_assertion': r'!\.',
    'keyof_typeof': r'\b(?:keyof|typeof)\s+',
    'indexed_access': r'\[\s*(?:number|string|symbol)\s*\]',
    'intersection_types': r'&\s*\w+',
    'union_types': r'\|\s*\w+',
    'infer_keyword': r'\binfer\s+\w+',
    'enum_types': r'\benum\s+\w+\s*\{',
    'abstract_classes': r'\babstract\s+class\s+',
    'decorators': r'@\w+(?:\([^)]*\))?',
    'type_assertions': r'\bas\s+\w+',
    'optional_chaining': r'\?\.',
    'nullish_coalescing': r'\?\?',
}

CSHARP_FEATURES = {
    'generics': r'<[^<>]+>',
    'nullable': r'\w+\?(?!\?)',
    'null_forgiving': r'![\.\[\(]',
    'var_keyword': r'\bvar\s+\w+',
    'dynamic_keyword': r'\bdynamic\s+\w+',
    'record': r'\brecord\s+(?:class|struct)?\s*\w+',
    'init': r'\binit\s*;',
    'pattern_matching': r'\bis\s+(?:not\s+)?(?:\w+|\{)',
    'switch_expression': r'=>',
    'tuple': r'\([^)]*,\s*[^)]*\)',
    'async_await': r'\b(?:async|await)\b',
    'linq': r'\b(?:from|where|select|join|group)\s+\w+',
}

RUST_FEATURES = {
    'generics': r'<[^<>]+>',
    'lifetimes': r"'[a-zA-Z_]\w*\b",
    'trait_bound': r'<[^<>]*\b\w+\s*:\s*[A-Z]\w*[^<>]*>',
    'where_clause': r'\bwhere\s+\w+\s*:',
    'impl_trait': r'\bimpl\s+[A-Z]\w*',
    'dyn_trait': r'\bdyn\s+[A-Z]\w*',
    'box_dyn': r'\bBox\s*<\s*dyn\s+',
    'type_alias': r'\btype\s+[A-Z]\w*\s*(<[^>]*>)?\s*=',
    'derive': r'#\[derive\([^\)]+\)\]',
    'match_expr': r'\bmatch\s+\w',
    'if_let': r'\b(?:if|while)\s+let\b',
    'enum_def': r'\benum\s+[A-Z]\w*',
    'struct_def': r'\bstruct\s+[A-Z]\w*',
    'trait_def': r'\btrait\s+[A-Z]\w*',
    'smart_pointer': r'\b(?:Arc|Rc|Mutex|RwLock|RefCell|Cell)\s*<',
    'option_result': r'\b(?:Option|Result)\s*<',
    'unsafe_impl': r'\bunsafe\s+impl\b',
    'transmute': r'\bmem::transmute\b|\btransmute\s*::\s*<',
    'any_trait': r'\b(?:std::)?any::Any\b|\bdyn\s+Any\b',
}

# A keyword pattern and what it scores.
SCORED_KEYWORDS = [
    (r'\btype\s+\w+\s*=', 12),
    (r'\binterface\s+\w+', 12),
    (r':\s*[A-Z][a-zA-Z]*\s*[;\)\}]', 10),
    (r'as\s+[A-Z][a-zA-Z]*', 8),
    (r'<[A-Z][a-zA-Z]*>', 7),
    (r'\btype\s+fix\b', 8),
    (r'\bfix.*type error\b', 9),
    (r'\bnoImplicitAny\b', 11),
    (r'\bstrictNullChecks\b', 11),
    (r'\badd.*\btype\b', 6),
    (r'\bimprove.*\btyping\b', 7),
    (r'\brefactor.*\btype\b', 6),
]
# A pattern of whole added lines, mark included, and what it scores: the first that matches counts.
SCORED_LINES = [
    (r'^\+\s*.*:\s*[a-zA-Z_][\w]*\s*[;\)\}]', 15),
    (r'^\+\s*.*:\s*[A-Z][a-zA-Z]*\s*[;\)\}]', 18),
    (r'^\+\s*(interface|type)\s+\w+', 25),
    (r'^\+\s*.*\s+as\s+[A-Z][a-zA-Z]*', 12),
    (r'^\+\s*.*<[^<>]*[A-Z][a-zA-Z][^<>]*>', 10),
    (r'^\+\s*.*:\s*any\b', 18),
]
# The same of added lines without marks and outer blanks.
SCORED_STRIPPED_LINES = [
    (r'.*:\s*[a-zA-Z_][\w]*\s*[;\)\}]', 15),
    (r'.*:\s*[A-Z][a-zA-Z]*\s*[;\)\}]', 18),
    (r'(interface|type)\s+\w+', 25),
    (r'.*\s+as\s+[A-Z][a-zA-Z]*', 12),
    (r'.*<[^<>]*[A-Z][a-zA-Z][^<>]*>', 10),
    (r'.*:\s*any\b', 18),
]
LEAST_TEXT, LEAST_PATCH, LEAST_TOTAL, PER_FILE = 10, 18, 28, 2
TYPE_KEYWORDS = [p for p, _ in SCORED_KEYWORDS]
PATCH_PATTERNS = [p for p, _ in SCORED_STRIPPED_LINES]
# Over the lines of a patch: at most once a line; and a typed removed line right before an added one that says any.
ANY_ADDED_LINE = r'^\+\s*.*:\s*any\b'
ANY_REMOVED_LINE = r'^\-\s*.*:\s*any\b'
ANY_REPLACED_LINES = r'^\-\s*.*:\s*([a-zA-Z_][\w\[\]<>]*)\s*[;\)\}]?\s*$\n^\+\s*.*:\s*any\b'
FALSE_POSITIVES = [
    r'type\s*=\s*["\']',
    r'typeof\s+\w+',
    r'@type\s+\{',
    r'console\.log.*type',
    r'button.*type',
    r'input.*type',
    r'\.d\.ts\b',
]
UNWRAP_PATTERN = r'\.\s*(?:unwrap|expect)\s*\('
AS_CAST_PATTERN = r'\bas\s+(?:[iu](?:8|16|32|64|128|size)|f32|f64|bool|char|usize|isize|\*(?:const|mut)|&)'
AI_AGENTS = ["OpenAI_Codex", "Devin", "Copilot", "Cursor", "Claude_Code"]

# The features of the TypeScript extractor, as written, over added lines with their marks.
TS_EXTRACTED = {
    'generics': r'(interface|type|class|function|declare\s+function|const\s+\w+\s*:\s*)\s*\w+\s*<[^<>]+>',
    'conditional_type': r'\bextends\b\s*[^?]*\?\s*[^:]*:\s*',
    'infer': r'\binfer\s+\w+\b',
    'mapped_type': r'\[\s*(readonly\s+)?([A-Za-z_]\w*)\s+in\s+keyof\s+\w+\s*(\s*\?)?\s*\]',
    'key_remap': r'\[[^\]]+in[^\]]+\bas\s+[A-Za-z_]\w+[^\]]*\]',
    'template_literal_type': r'`[^`]*\$\{[^}]+}[^`]*`',
    'satisfies': r'\s+satisfies\s+',
    'as_const': r'\bas\s+const\b',
    'non_null_assertion': r'!\s*([\.\[(])',
    'type_guard_is': r':\s*\(?\s*\w+\s+is\s+\w+',
    'keyof': r'\bkeyof\b',
    'typeof': r'\btypeof\b',
    'in_operator': r'\[[^\]]*\bin\b[^\]]*\]',
    'intersection_type': r'[A-Za-z0-9)\]]\s*&\s*[A-Za-z0-9(\[]',
    'union_type': r'[A-Za-z0-9)\]]\s*\|\s*[A-Za-z0-9(\[]',
    'indexed_access': r'\w+\s*\[\s*keyof\s*\w+\s*\]',
    'utility_type_usage': r'\b(Partial|Required|Readonly|Pick|Omit|Record|ReturnType|InstanceType|Parameters|ConstructorParameters|Awaited|ThisType|Exclude|Extract|NonNullable)\s*<',
    'recursive_type': r'type\s+(\w+)\s*=\s*.*\b\1\b',
    'const_assertion': r'(as\s+const)|(\{[^}]+\}\s+as\s+const)',
    'discriminated_union': r'\b(kind|type|tag)\s*:\s*(\'[A-Za-z_0-9]+\'|"[A-Za-z_0-9]+")',
    'unique_symbol': r'\bunique\s+symbol\b',
    'readonly_modifier': r'\b(readonly\s+([A-Za-z_]\w+|\[))|(\{[^}]*readonly\s+\w+:[^}]*\})',
    'optional_property': r'\w+\s*\?:',
}
# Those of human changes in TypeScript: likewise.
TS_HUMAN = {
    'generics': r'(interface|type|class|function)\s+\w*\s*<[^<>]+>',
    'conditional_type': r'\bextends\b[^?]+\?.+:.+',
    'satisfies': r'\s+satisfies\s+',
    'as_const': r'\bas\s+const\b',
    'non_null_assertion': r'!\s*([\.\[(])',
    'type_guard_is': r':\s*\(?\s*\w+\s+is\s+\w+',
    'keyof_typeof': r'\bkeyof\s+typeof\b',
}
# The analysis of features counts these besides, in either case, over all lines that start with the mark.
TS_ANALYSIS = TS_FEATURES | {
    'discriminated_unions': r'(?:type|interface)\s+\w+\s*=\s*(?:\{[^}]*\|\s*[^}]*\}|\w+\s*\|\s*\w+)',
    'type_predicates': r':\s*\w+\s+is\s+\w+',
    'namespace_types': r'namespace\s+\w+\s*\{',
}
TS_SUBSET = {k: TS_FEATURES[k] for k in ('generics', 'union_types', 'type_assertions', 'optional_chaining', 'non_null_assertion', 'type_guards', 'satisfies', 'as_const', 'nullish_coalescing', 'keyof_typeof')}
CSHARP_ANALYSIS = CSHARP_FEATURES | {
    'readonly_struct': r'\breadonly\s+struct',
    'ref_struct': r'\bref\s+struct',
    'in_parameter': r'\bin\s+\w+',
    'out_parameter': r'\bout\s+\w+',
    'ref_parameter': r'\bref\s+\w+',
}
CSHARP_NULLS = {
    'null_coalescing': r'\?\?',
    'null_conditional': r'\?\.',
}
CSHARP_SUBSET = {k: CSHARP_FEATURES[k] for k in ('generics', 'nullable', 'null_forgiving', 'pattern_matching', 'async_await', 'linq')} | CSHARP_NULLS
CSHARP_SAFETY = {k: CSHARP_FEATURES[k] for k in ('null_forgiving', 'nullable', 'pattern_matching')} | CSHARP_NULLS
TS_SAFETY = {k: TS_ANALYSIS[k] for k in ('type_guards', 'non_null_assertion', 'type_predicates', 'satisfies', 'as_const')}
# As written, over added lines without marks.
RUST_ANALYSIS = RUST_FEATURES | {
    'phantom_data': r'\bPhantomData\s*<',
    'impl_block': r'\bimpl(?:\s*<[^>]+>)?\s+[A-Z]\w*',
    'send_sync': r'\b(?:Send|Sync)\b',
}
# How features count in tiers and scores.
TIERS = {
    'Basic': ['union_types', 'type_assertions', 'optional_chaining', 'nullish_coalescing'],
    'Intermediate': ['generics', 'utility_types', 'keyof_typeof', 'as_const'],
    'Advanced': ['conditional_types', 'type_guards', 'satisfies', 'intersection_types'],
}
SOPHISTICATION = {
    'generics': 2.0,
    'conditional_types': 3.0,
    'mapped_types': 3.0,
    'type_guards': 2.5,
    'utility_types': 1.5,
    'satisfies': 2.5,
    'template_literals': 2.0,
    'union_types': 1.0,
    'intersection_types': 1.5,
    'as_const': 1.5,
}
MODERN = ['optional_chaining', 'nullish_coalescing', 'satisfies', 'template_literals']
LEGACY = ['type_assertions', 'namespace_types', 'enum_types']

# The catalogues of the C# and Rust extractors: keywords and false positives in either case, patch patterns and features as written, over added lines without marks.
CSHARP_KEYWORDS = [
    r'\bclass\s+\w+',
    r'\binterface\s+\w+',
    r'\bstruct\s+\w+',
    r'\benum\s+\w+',
    r'\brecord\s+\w+',
    r':\s*\w+\s*[;\)\},]',
    r'\bas\s+\w+',
    r'<[^<>]+>',
    r'\?[;\)\},]',
    r'!\s*[\.\[\(]',
    r'\btypeof\s*\(',
    r'\bwhere\s+',
    r'\bvar\s+',
    r'\bdynamic\s+',
    r'\binit\s*;',
    r'\brequired\s+',
    r'\brecord\s+',
    r'#nullable',
]
CSHARP_PATCH_PATTERNS = [
    r'.*:\s*\w+\s*[;\)\},]',
    r'.*\bas\s+\w+',
    r'.*<[^<>]+>',
    r'.*\?[;\)\},]',
    r'.*\s+var\s+',
    r'.*\s+record\s+',
    r'.*\s+typeof\s*\(',
    r'.*\s+where\s+',
    r'.*\s+(?:class|interface|struct)\s+\w+',
]
CSHARP_FALSE_POSITIVES = [
    r'type\s*=\s*["\']',
    r'content[_-]?type',
    r'mime[_-]?type',
    r'@type',
]
CSHARP_EXTRACTED = {
    'generics': r'<[^<>]+>',
    'nullable': r'\w+\?(?!\?)',
    'null_forgiving': r'![\.\[\(]',
    'var': r'\bvar\s+\w+',
    'dynamic': r'\bdynamic\s+\w+',
    'record': r'\brecord\s+(?:class|struct)?\s*\w+',
    'init': r'\binit\s*;',
    'required': r'\brequired\s+\w+',
    'is_pattern': r'\bis\s+(?:not\s+)?\w+',
    'typeof': r'\btypeof\s*\(',
    'as_cast': r'\bas\s+\w+',
    'explicit_cast': r'\([A-Z]\w*[<>\[\]]*\)\s*\w+',
    'generic_constraints': r'\bwhere\s+\w+\s*:\s*\w+',
    'variance': r'<\s*(?:in|out)\s+\w+',
    'tuple': r'\([\w\s,<>\[\]]+,[\w\s,<>\[\]]+\)',
    'delegate': r'\bdelegate\s+\w+',
    'attribute': r'\[[A-Z]\w*(?:\([^\)]*\))?\]',
    'inheritance': r'\b(?:class|interface|struct)\s+\w+\s*:\s*\w+',
    'type_alias': r'\busing\s+\w+\s*=\s*[\w<>,\s\[\]\.]+;',
    'nullable_directive': r'#nullable\s+(?:enable|disable|restore)',
    'readonly_struct': r'\breadonly\s+struct\s+\w+',
    'ref_struct': r'\bref\s+struct\s+\w+',
    'ref_readonly': r'\bref\s+readonly\s+\w+',
}
RUST_KEYWORDS = [
    r'\btrait\s+\w+',
    r'\bstruct\s+\w+',
    r'\benum\s+\w+',
    r'\btype\s+\w+\s*=',
    r'\bimpl\s+',
    r'\bunsafe\b',
    r'\bdyn\s+\w+',
    r'\bBox\s*<',
    r'<[^<>]+>',
    r"'[a-zA-Z_]\w*\b",
    r'\bwhere\s+',
    r'\bderive\s*\(',
    r'\bOption\s*<',
    r'\bResult\s*<',
    r'\bArc\s*<',
    r'\bMutex\s*<',
    r'\bPhantomData\b',
    r'\bSend\b|\bSync\b',
    r'\bborrow checker\b',
    r'\blifetime\b',
    r'\btype\s+annotation\b',
    r'\btype\s+safety\b',
    r'\btype\s+system\b',
    r'\bfix.*type error\b',
]
RUST_PATCH_PATTERNS = [
    r'.*:\s*[a-zA-Z_][\w:]*(?:<[^<>]*>)?',
    r'.*\bfn\s+\w+',
    r'.*\bstruct\s+\w+',
    r'.*\benum\s+\w+',
    r'.*\btrait\s+\w+',
    r'.*\bimpl\s+',
    r'.*\bunsafe\b',
    r'.*\bdyn\s+',
    r'.*\bBox\s*<',
    r'.*<[^<>]+>',
    r".*'[a-z_]\w*",
]
RUST_FALSE_POSITIVES = [
    r'^\s*//\s*SAFETY\s*:',
    r'^\s*//[!/].*\btype\b',
    r'content[_-]?type',
    r'mime[_-]?type',
]
RUST_EXTRACTED = {
    'generics': r'<[^<>]+>',
    'lifetime': r"'[a-zA-Z_]\w*\b",
    'trait_bound': r'<[^<>]*\b\w+\s*:\s*[A-Z]\w*[^<>]*>',
    'where_clause': r'\bwhere\s+\w+\s*:',
    'impl_trait': r'\bimpl\s+[A-Z]\w*',
    'dyn_trait': r'\bdyn\s+[A-Z]\w*',
    'box_dyn': r'\bBox\s*<\s*dyn\s+',
    'type_alias': r'\btype\s+[A-Z]\w*\s*(<[^>]*>)?\s*=',
    'associated_type': r'\btype\s+[A-Z]\w*\s*=',
    'phantom_data': r'\bPhantomData\s*<',
    'derive': r'#\[derive\([^\)]+\)\]',
    'match': r'\bmatch\s+\w',
    'if_let': r'\b(?:if|while)\s+let\b',
    'enum': r'\benum\s+[A-Z]\w*',
    'struct': r'\bstruct\s+[A-Z]\w*',
    'trait': r'\btrait\s+[A-Z]\w*',
    'impl_block': r'\bimpl(?:\s*<[^>]+>)?\s+[A-Z]\w*',
    'send_sync': r'\b(?:Send|Sync)\b',
    'smart_pointer': r'\b(?:Arc|Rc|Mutex|RwLock|RefCell|Cell)\s*<',
    'option_result': r'\b(?:Option|Result)\s*<',
    'unsafe_impl': r'\bunsafe\s+impl\b',
    'transmute': r'\bmem::transmute\b|\btransmute\s*::\s*<',
    'any_trait': r'\b(?:std::)?any::Any\b|\bdyn\s+Any\b',
}
# What human changes in C# count: the first of the extractor's, over added lines with their marks.
CSHARP_HUMAN = {k: CSHARP_EXTRACTED[k] for k in ('generics', 'nullable', 'null_forgiving', 'var', 'dynamic', 'record', 'init', 'required', 'is_pattern', 'typeof', 'as_cast')}
