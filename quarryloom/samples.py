"""Small sources in each language that is cut by structure, and the chunks they have, written by hand."""

SOURCES = {
    "a.go": "package a\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) Get(\n\ty int,\n) (int, error) {\n\t// }\n\treturn t.x, nil\n}\n\nfunc F() string { return \"}\" }\n",
    "b.js": "import x from 'y';\n\nexport class A {\n  constructor(x) {\n    if (x) {\n      this.x = `}`;\n    }\n  }\n  async load() {\n    return 1;\n  }\n}\n\nconst add = (a, b) => {\n  return a + b;\n};\n",
    "c.ts": "interface P {\n  name: string;\n}\n\ntype Q = string;\n\nclass B {\n  private get(x: number): string {\n    return '';\n  }\n}\n",
    "d.rs": "impl<'a> Foo<'a> {\n    pub fn new(x: &'a str) -> Self {\n        Foo { x }\n    }\n\n    fn get(&self) -> char {\n        '}'\n    }\n}\n\nmod m {\n    pub struct S;\n}\n",
    "e.java": "package p;\n\npublic class A {\n    /* { */\n    public A(int x) {\n        this.x = x;\n    }\n\n    static <T> List<T> of(T x) {\n        return new Foo(x);\n    }\n}\n",
    "f.c": "#include <a.h>\n\nstatic int n = 3;\n\nstruct point {\n    int x;\n};\n\nint add(int a, int b)\n{\n    if (a) {\n        return b;\n    }\n    return a + b;\n}\n",
    "g.cpp": "namespace n {\nclass K {\n  public:\n    int get() const {\n        return 1;\n    }\n};\n}\n",
    "h.rb": "module M\n  class C\n    def self.make\n      new\n    end\n\n    def run!\n      if x\n        1\n      end\n    end\n  end\nend\n",
    "i.py": "class C:\n    @property\n    def x(self):\n        return 1\n\n    def y(self):\n        return 2\n",
}

#: first line, last line, node type, name; of every node over 30 bytes the nodes inside it too.
CHUNKS = {
    "a.go": [(3, 5, "type_declaration", "T"), (7, 12, "method_declaration", "Get"), (14, 14, "function_declaration", "F")],
    "b.js": [(3, 12, "export_statement", "A"), (4, 8, "method_definition", "constructor"), (9, 11, "method_definition", "load"), (14, 16, "arrow_function", "add")],
    "c.ts": [(1, 3, "interface_declaration", "P"), (5, 5, "type_alias_declaration", "Q"), (7, 11, "class_declaration", "B"), (8, 10, "method_definition", "get")],
    "d.rs": [(1, 9, "impl_item", "Foo"), (2, 4, "function_item", "new"), (6, 8, "function_item", "get"), (11, 13, "mod_item", "m")],
    "e.java": [(3, 12, "class_declaration", "A"), (5, 7, "constructor_declaration", "A"), (9, 11, "method_declaration", "of")],
    "f.c": [(3, 3, "declaration", "n"), (5, 7, "struct_specifier", "point"), (9, 15, "function_definition", "add")],
    "g.cpp": [(1, 8, "namespace_definition", "n"), (2, 7, "class_specifier", "K"), (4, 6, "function_definition", "get")],
    "h.rb": [(1, 13, "module", "M"), (2, 12, "class", "C"), (3, 5, "singleton_method", "make"), (7, 11, "method", "run!")],
    "i.py": [(1, 7, "class_definition", "C"), (2, 4, "decorated_definition", "x"), (6, 7, "function_definition", "y")],
}
