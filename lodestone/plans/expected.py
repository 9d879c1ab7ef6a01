"""Rows that queries over the fixed source files give, derived by hand from those files."""

LOOKAHEAD = [
    ("src/Cart.tsx", "missing_alt_text", "ACCESSIBILITY", "MEDIUM", 0.8, 0, 26, '<img src="x.png">'),
    ("src/Cart.tsx", "missing_aria_label", "ACCESSIBILITY", "LOW", 0.8, 0, 27, "<button onClick={onCheckout}/>"),
    ("src/legacy.js", "event_listener_leak", "MEMORY_LEAK", "MEDIUM", 0.8, 0, 8, "window.addEventListener('resize', draw);"),
]

_STYLE = "return <ul style={{ margin: 4 }} onClick={() => this.close()}>"
_MONEY = "import { formatPrice } from '../../../../lib/money';"
FINDINGS = [
    ("src/Cart.tsx", "inline_object_prop", "PERFORMANCE_ISSUE", "MEDIUM", 0.8, 23, _STYLE),
    ("src/Cart.tsx", "inline_object_prop", "PERFORMANCE_ISSUE", "MEDIUM", 0.8, 28, "<div dangerouslySetInnerHTML={{ __html: items }} />"),
    ("src/Cart.tsx", "inline_function_prop", "PERFORMANCE_ISSUE", "MEDIUM", 0.8, 23, _STYLE),
    ("src/Cart.tsx", "dangerous_html", "SECURITY_RISK", "HIGH", 0.8, 28, "<div dangerouslySetInnerHTML={{ __html: items }} />"),
    ("src/Cart.tsx", "direct_state_mutation", "ANTI_PATTERN", "HIGH", 0.8, 22, "items.push(1);"),
    ("src/Cart.tsx", "missing_cleanup", "MEMORY_LEAK", "HIGH", 0.8, 18, "setInterval(refresh, 1000);"),
    ("src/Cart.tsx", "unused_import", "IMPORT_INCONSISTENCY", "LOW", 0.8, 1, "import { useState, useEffect } from 'react';"),
    ("src/Cart.tsx", "unused_import", "IMPORT_INCONSISTENCY", "LOW", 0.8, 2, _MONEY),
    ("src/Cart.tsx", "relative_import_depth", "IMPORT_INCONSISTENCY", "MEDIUM", 0.8, 2, _MONEY),
    ("src/Cart.tsx", "any_type_usage", "TYPE_SAFETY", "MEDIUM", 0.8, 6, "interface LineProps<T> { item: T; total: any }"),
    ("src/Cart.tsx", "any_type_usage", "TYPE_SAFETY", "MEDIUM", 0.8, 10, "export function subtotal(items: any[], rate?: number): number {"),
    ("src/Cart.tsx", "missing_alt_text", "ACCESSIBILITY", "MEDIUM", 0.8, 26, '<img src="x.png">'),
    ("src/Cart.tsx", "missing_aria_label", "ACCESSIBILITY", "LOW", 0.8, 27, "<button onClick={onCheckout}/>"),
    ("src/legacy.js", "hooks_conditional", "HOOK_VIOLATION", "CRITICAL", 0.8, 3, "if (ready) { useEffect(run); }"),
    ("src/legacy.js", "hooks_in_loop", "HOOK_VIOLATION", "CRITICAL", 0.8, 2, "for (let i = 0; i < 3; i++) { const v = useMemo(() => i, []); }"),
    ("src/legacy.js", "hooks_in_function", "HOOK_VIOLATION", "HIGH", 0.8, 4, "function helper(x) { return useState(x); }"),
    ("src/legacy.js", "eval_usage", "SECURITY_RISK", "CRITICAL", 0.8, 1, "// eval(1) in a comment"),
    ("src/legacy.js", "eval_usage", "SECURITY_RISK", "CRITICAL", 0.8, 6, 'eval("2 + 2");'),
    ("src/legacy.js", "document_write", "SECURITY_RISK", "HIGH", 0.8, 5, 'document.write("<p>");'),
    ("src/legacy.js", "event_listener_leak", "MEMORY_LEAK", "MEDIUM", 0.8, 8, "window.addEventListener('resize', draw);"),
    ("src/legacy.js", "non_null_assertion", "TYPE_SAFETY", "MEDIUM", 0.8, 7, "node!.remove();"),
    ("src/legacy.js", "hooks_conditional_any", "HOOK_VIOLATION", "CRITICAL", 0.8, 3, "if (ready) { useEffect(run); }"),
    ("src/Cart.tsx", "this_in_functional_component", "ANTI_PATTERN", "HIGH", 0.9, 23, "this in Cart"),
    ("src/Cart.tsx", "complex_state_mutation", "ANTI_PATTERN", "HIGH", 0.7, 21, "mutates lines"),
    ("src/Cart.tsx", "missing_effect_dependencies", "HOOK_VIOLATION", "MEDIUM", 0.6, 17, "1000, lines, log, refresh, setInterval"),
    ("src/Cart.tsx", "prop_drilling", "ANTI_PATTERN", "LOW", 0.5, 1, "theme x 4"),
    ("src/legacy.js", "potential_cyclic_dependency", "IMPORT_INCONSISTENCY", "MEDIUM", 0.4, 1, "6"),
    ("src/Cart.tsx", "empty_interface", "TYPE_SAFETY", "LOW", 0.9, 4, "Empty"),
    ("src/Cart.tsx", "inline_styles", "PERFORMANCE_ISSUE", "LOW", 0.7, 23, "inline style"),
]

PYTHON_FACTS = [
    ("src/shop/model.py", "import", None, "os", 1, None, None),
    ("src/shop/model.py", "import", None, ".base", 2, "Base", None),
    ("src/shop/model.py", "class", None, "Item", 5, "Base", None),
    ("src/shop/model.py", "attribute", "Item", "price", 6, None, "float"),
    ("src/shop/model.py", "method", "Item", "total", 9, "n:int=1; [var_positional] *more:str; [keyword_only] tax:Any=None; [var_keyword] **rest:Dict[str, Any]", "float"),
    ("src/shop/model.py", "function", None, "load", 18, "path:Any", "Any"),
    ("src/shop/model.py", "function", None, "inner", 10, "x:Any", "Any"),
    ("src/shop/broken.py", "error", None, "SyntaxError", 1, None, None),
]

TSX_LINES = [
    ("src/Cart.tsx", "import", "react", 1, "{ useState, useEffect }"),
    ("src/Cart.tsx", "import", "../../../../lib/money", 2, "{ formatPrice }"),
    ("src/Cart.tsx", "export", "subtotal", 10, ""),
    ("src/Cart.tsx", "component", "Cart", 14, "function"),
    ("src/Cart.tsx", "export", "Cart", 14, ""),
    ("src/Cart.tsx", "hook", "useState", 15, "[lines, setLines]"),
    ("src/Cart.tsx", "hook", "useEffect", 17, ""),
    ("src/Cart.tsx", "hook", "useCallback", 33, ""),
    ("src/Cart.tsx", "hook", "useMemo", 34, ""),
    ("src/legacy.js", "hook", "useMemo", 2, "v"),
    ("src/legacy.js", "hook", "useEffect", 3, ""),
    ("src/legacy.js", "hook", "useState", 4, ""),
    *(("src/legacy.js", "import", f"./{x}", 10 + i, x) for i, x in enumerate("abcdef")),
    ("src/Label.tsx", "import", "react", 1, "React"),
    ("src/Label.tsx", "component", "Label", 3, "function"),
    ("src/Label.tsx", "export", "Label", 3, ""),
]
