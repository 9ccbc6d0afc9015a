"""Word lists, tables and patterns that results depend on.

They are data, stated in their natural order; all logic is elsewhere.
Patterns are Java regular expressions.
"""

# words that carry no topic (fixed values)
STOP_WORDS = """the a an to of in on for and or with is are be do i you it this that my me
help please can could would make create add fix update change use using how what why get set
run give write show me my we our just now like need want file code app page 帮 我 你 的 了 吗 呢
一下 这个 那个 请 把 给 用 做 个 想 需要 现在 一个 可以 然后 还有 一些 这里 目前""".split()

WORD = r"[A-Za-z][A-Za-z0-9_\-]{2,}|[一-鿿]{2,}"
CJK = r"[一-鿿]"

# texts that tools inject, wrappers before a request, and prefixes of non-prompts (fixed values)
INJECTED = [
    "The following is the Codex agent history", "Another Claude session sent",
    "The coordinator sent a message", "<teammate-message", "# Instructions (read first)",
    "prompt injection resistance", "Treat the transcript", "approval assessment",
    "You are Codex", "You are Claude", "system-reminder", "System-Reminder",
    "<system-reminder", "Caveat:", "This session is being", "You are a memory extractor",
]
WRAPPERS = ["## My request for Codex:", "My request for Codex:", "## My request:", "My request:"]
NOT_PROMPTS = ["<", "[Request interrupted", "Contents of", "command-", "API Error", "FILE UNDER AUDIT"]
LEADING_IMAGES = r"^\s*(\[Image[^\]]*\]\s*)+"

# signs of a correction, of acceptance criteria, and of a wish to discuss first (fixed values)
CORRECTION = (
    "不是这样|不是我的意思|我是说|不对|错了|重新|你误解|不要这样|别这样|理解错|搞错|不太对|"
    "还是不|太丑|太多了|信息过载|不够|没对齐|不符合|不友好|没有按照|"
    r"\bactually,?\s|that.?s not|i meant|not what i|no,\s|wrong|revert|undo"
)
ACCEPTANCE = (
    "验收|确保|必须|别忘|不要|别改|保持|跑通|测一下|跑一下测试|通过测试|符合|不能|"
    r"acceptance|make sure|must\b|do ?n.?t\b|ensure|verify that|should not"
)
DISCUSS = (
    "先讨论|先别写|别急着写|先说思路|先给方案|先聊|讨论清楚|先不要动手|先出.{0,4}计划|"
    "do ?n.?t code yet|let.?s discuss|before you (write|code|start)"
)

# redaction rules in order (fixed values); the home directory is a parameter
REDACTIONS = [
    (r"sk-[A-Za-z0-9_\-]{16,}", "<KEY>"),
    (r"(?i)bearer\s+[A-Za-z0-9._\-]{10,}", "Bearer <KEY>"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    (r"(?i)(api[_\-]?key|token|secret|password)\s*[=:]\s*[^\s\"']{6,}", "$1=<REDACTED>"),
]
STRICT_SECRET = (r"(?i)(api[_\-]?key|token|secret|password)\s*[=:]\s*([\"']?)[^\s\"']{6,}\2", "$1=<REDACTED>")

# directories below which a project lies, in order of precedence (fixed values)
ANCHORS = ["Projects", "Downloads", "Desktop", "Documents"]
GENERIC_NAMES = [
    "codex", "downloads", "projects", "desktop", "documents", "none", "tmp", "src", "clawd",
    "library", "applications", "movies", "music", "pictures", "public", "home", "users",
]
FILE_LIKE = r"(?i)\.(app|md|json|html?|py|ts|js|mjs|txt|png|jpg|csv)$"

# package installation (fixed values)
INSTALL = (
    r"(?i)\b(?:npm\s+(?:i|install|add)|pnpm\s+(?:add|install|i)|yarn\s+add|bun\s+(?:add|install)|"
    r"(?:python[0-9.]*\s+-m\s+)?pip[0-9]?\s+install|uv\s+(?:add|pip\s+install)|poetry\s+add|"
    r"cargo\s+add|go\s+(?:get|install)|brew\s+install|gem\s+install)\s+([^\n&|;]+)"
)
INSTALL_VERBS = ["install", "add", "i", "pip", "get"]
MANAGERS = ["npm", "pnpm", "yarn", "bun", "npx", "pip", "pip3", "uv", "poetry", "cargo", "go", "brew", "gem"]

# verification habits of a command, first match (fixed values)
VERIFICATION = [
    ("test", r"(?i)\b(pytest|vitest|jest|cypress|playwright|unittest|npm\s+test|yarn\s+test|pnpm\s+test|go\s+test|cargo\s+test)"),
    ("git", r"(?i)^git\b"),
    ("typecheck", r"(?i)\b(tsc|mypy|pyright|eslint|biome|ruff|flake8|prettier)\b"),
    ("build", r"(?i)\b(make|webpack|vite|next|cargo\s+build|uvicorn|npm\s+run)\b"),
]
EDIT_TOOLS = ["Edit", "Write", "NotebookEdit"]

# themes of corrections, first match (fixed values): for profiles, and for reports
PROFILE_THEMES = [
    ("审美 / UI 打磨", "丑|难看|审美|不好看|配色|色|样式|太素|视觉|排版|间距|字号|对不齐|层级"),
    ("去黑话 / 说人话", "黑话|术语|说人话|通俗|太专业|大白话|别用.{0,3}词"),
    ("禁 mock / 要真实", "mock|假数据|真实数据|写死|hard ?code|硬编码|造数据|占位|placeholder"),
    ("对齐 / 按要求来", "没对齐|不符合|没有按照|按我说的|不是我要的|没按|跑偏|偏离|自作主张|别自己"),
    ("信息过载 / 精简", "太多|信息过载|太长|啰嗦|冗余|精简|删掉|去掉.{0,4}多余|太啰"),
    ("返工 / 推倒重来", "重新|重做|revert|undo|再来|推倒|回退|从头"),
]
PROFILE_OTHER = "其他"
REPORT_THEMES = [
    ("审美与质感", "丑|精致|设计感|质感|纹路|颜色|色调|好看|动画|样式|视觉|画风"),
    ("说人话", "(?i)术语|用户友好|文案|黑话|技术用语|性感|value|proposition|表达"),
    ("做减法", "过载|精简|太多|剃刀|优雅|包袱|信息量|溢出|挤"),
    ("真实与可溯源", "(?i)mock|溯源|证据|假|真实|召回|数据.*不|不.*数据"),
]
REPORT_OTHER = "其它对齐"
JUNK_CLUSTER = r"(?i)^\s*#|OVERRIDE|ssh-ed25519|authorized_keys|Continue from where"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TOP_FAMILY = "opus"
FILLER_OPENER = "^(可以的|好的|继续|然后|对了|嗯|是的)"

# libraries that prompts mention, and spellings that count as another (fixed values)
LIBRARIES = [
    "react", "next.js", "next", "vue", "svelte", "solid", "angular", "astro",
    "tailwind", "shadcn", "radix", "chakra", "mui", "assistant-ui",
    "vite", "webpack", "turbopack", "esbuild", "rollup", "turborepo",
    "framer motion", "framer-motion", "gsap", "anime.js", "animejs", "three.js", "three",
    "d3", "p5.js", "p5", "recharts", "visx",
    "lexical", "codemirror", "tiptap", "prosemirror",
    "bullmq", "redis", "postgres", "drizzle", "prisma", "sqlite", "mongodb", "supabase",
    "trpc", "better auth", "better-auth", "clerk", "nextauth", "zod", "zustand", "jotai",
    "redux", "react-query", "tanstack", "playwright", "vitest", "jest", "cypress",
    "biome", "eslint", "prettier", "ruff", "mypy",
    "pi-ai", "langchain", "anthropic", "openai", "ollama",
    "fastapi", "flask", "django", "express", "hono", "fastify",
    "pandas", "numpy", "pytorch", "tensorflow", "onnxruntime", "fastembed", "openpyxl",
    "docker", "kubernetes", "terraform",
]
LIBRARY_ALIASES = {"next": "next.js", "three": "three.js", "animejs": "anime.js", "p5": "p5.js", "framer-motion": "framer motion", "better-auth": "better auth"}

# technology groups in order of display; (name as observed, name as shown) (fixed values)
STACK = {
    "前端/UI": [
        ("react", "React"), ("next.js", "Next.js"), ("next", "Next.js"), ("vue", "Vue"), ("svelte", "Svelte"), ("solid", "Solid"),
        ("angular", "Angular"), ("astro", "Astro"), ("tailwind", "Tailwind"), ("shadcn", "shadcn/ui"), ("radix", "Radix"),
        ("chakra", "Chakra"), ("mui", "MUI"), ("framer motion", "Framer Motion"), ("framer-motion", "Framer Motion"), ("gsap", "GSAP"),
        ("anime.js", "anime.js"), ("animejs", "anime.js"), ("three.js", "Three.js"), ("three", "Three.js"), ("d3", "D3"), ("p5.js", "p5.js"),
        ("recharts", "Recharts"), ("visx", "visx"), ("zustand", "Zustand"), ("jotai", "Jotai"), ("redux", "Redux"),
        ("assistant-ui", "assistant-ui"), ("vite", "Vite"),
    ],
    "编辑器": [("lexical", "Lexical"), ("codemirror", "CodeMirror"), ("tiptap", "Tiptap"), ("prosemirror", "ProseMirror")],
    "数据/后端": [
        ("postgres", "Postgres"), ("drizzle", "Drizzle"), ("drizzle-orm", "Drizzle"), ("prisma", "Prisma"), ("sqlite", "SQLite"),
        ("mongodb", "MongoDB"), ("supabase", "Supabase"), ("trpc", "tRPC"), ("zod", "Zod"), ("redis", "Redis"), ("bullmq", "BullMQ"),
        ("fastapi", "FastAPI"), ("flask", "Flask"), ("django", "Django"), ("express", "Express"), ("hono", "Hono"), ("fastify", "Fastify"),
        ("better auth", "Better Auth"),
    ],
    "测试/质量": [
        ("playwright", "Playwright"), ("playwright-core", "Playwright"), ("vitest", "Vitest"), ("jest", "Jest"), ("cypress", "Cypress"),
        ("biome", "Biome"), ("eslint", "ESLint"), ("prettier", "Prettier"), ("ruff", "Ruff"), ("mypy", "mypy"),
    ],
    "AI/Agent": [("anthropic", "Anthropic SDK"), ("openai", "OpenAI SDK"), ("pi-ai", "pi SDK"), ("langchain", "LangChain"), ("ollama", "Ollama")],
    "桌面/基建": [("tauri", "Tauri"), ("docker", "Docker"), ("kubernetes", "Kubernetes"), ("terraform", "Terraform")],
    "数据处理": [
        ("pandas", "pandas"), ("numpy", "NumPy"), ("pytorch", "PyTorch"), ("tensorflow", "TensorFlow"), ("onnxruntime", "ONNX Runtime"),
        ("openpyxl", "openpyxl"),
    ],
}

# languages by file extension (fixed values)
LANGUAGES = [
    (".ts", "TypeScript"), (".tsx", "TypeScript"), (".js", "JavaScript"), (".mjs", "JavaScript"), (".cjs", "JavaScript"),
    (".html", "HTML/前端"), (".css", "CSS"), (".py", "Python"), (".rs", "Rust"), (".swift", "Swift"), (".go", "Go"), (".java", "Java"),
    (".kt", "Kotlin"), (".rb", "Ruby"), (".php", "PHP"), (".c", "C"), (".cpp", "C++"), (".sql", "SQL"), (".sh", "Shell"),
]

# terms that are no names (fixed values)
CJK_COMMON = """这个 那个 一下 一个 问题 分析 代码 目前 现在 已经
可以 需要 应该 帮我 你的 我的 我们 他们 什么 怎么
为什么 如果 因为 所以 但是 而且 然后 首先 其次 最后
基于 对比 详细 整体 部分 内容 功能 实现 设计 优化
修改 检查 生成 创建 使用 支持 数据 模型 文件 页面
组件 版本 时间 上面 下面 左侧 右侧 报错 完整 直接
重新 一起 还是 感觉 觉得 确认 继续 增加 删除 调整
一样 不是 没有 这里 这样 看一下 帮我看 是不是 这些
以及 或者 这段 这句 一点 东西 方案 逻辑 结构 情况
问题的 的话 一版 目录 字段 接口 服务 配置 参数 结果
对话 输入 项目 测试 建议 记忆 用户 另外 下这 名字
时候 开始 完成 运行 输出 格式 样式 颜色 布局 交互
字段的 一段 一句 一条 地方 样子 过程 状态 信息 系统""".split()
ENGLISH_COMMON = """API JSON HTML CSS HTTP HTTPS URL URI SQL UI UX
ID OK TODO FIXME README AI APP APIs DOM CDN OS
PDF PNG JPG CSV YAML XML The This That And
Projects SKILL Star Office Continue Please With
Base User Instructions Instruction Directory Request
Rule Override Response Requirements Outputs Section""".split()
PROPER_NOUN = r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[A-Z]{2,6}|[A-Z][a-z]{2,})\b"
CJK_RUN = r"[一-鿿]{2,}"

# sentences of exported facts and topics, which must be these (fixed values)
FACT_TOPICS = {"stack": "技术栈", "language": "语言", "project": "项目", "style": "协作风格"}
STACK_SENTENCE = "%s常用:%s(据本地 AI 使用记录归纳)"
LANGUAGE_SENTENCE = "主力技术/语言:%s"
PROJECT_SENTENCE = "近期主要在这些项目上工作:%s"
TOPIC_SENTENCE = "经常在「%s」项目上工作(AI 会话占比约 %s%%)"
#: Conditions on a one-row frame of shares, as SQL, and what they say; a median of 0 is none.
STYLE_RULES = [
    ("cjk_share >= 0.7", "习惯用中文下达指令,书面化/润色应保持中文表达"),
    ("terse_share >= 0.4 OR (median_chars > 0 AND median_chars < 40)", "指令偏简短直接,常用一句话表达需求"),
    ("acceptance_rate >= 0.1", "布置任务时常附明确的验收标准或约束条件"),
    ("discuss_first_rate >= 0.05", "复杂任务倾向先讨论方案再动手实现"),
]
