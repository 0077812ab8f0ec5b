"""Fixed values.

Everything in this file is data that results must agree on: word lists, labels,
messages, thresholds and prompt wording. No logic lives here.
"""

# --- fixed values: enumerations -------------------------------------------------------
ROLES = ["Machine Learning Engineer", "Data Scientist", "Data Analyst", "AI Engineer"]
LEVELS = ["Junior", "Mid", "Senior"]
DEFAULT_TYPE = "Technical"
BEHAVIORAL_TYPE = "Behavioral"
SECTION_LABELS = ["SCORE", "SUMMARY", "STRENGTHS", "WEAKNESSES", "IMPROVEMENT_TIPS", "IMPROVED_ANSWER"]

# --- fixed values: numbers ------------------------------------------------------------
ROLE_QUOTA = 150
BEHAVIORAL_ROWS = 150
RECENT_SCORES = 3
DEFAULT_AVERAGE = 5.0
EASIER_BELOW = 5.0
HARDER_FROM = 8.0
DEFAULT_SCORE = 5.0
MOCK_SCORE = 7.0
MIN_QUESTION_LENGTH = 15
MIN_BACKGROUND_LENGTH = 15
RETRIEVED = 20
REFERENCES = 5
RATE_LIMITS = {"upload": 5, "strategy": 5, "report": 5, "start": 10, "frame": 10, "evaluate": 10}

# --- fixed values: whitespace removed by a strip ----------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# the page scripts trim another set: with the byte order mark, without separators 1c-1f and 85
PAGE_WHITESPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# --- fixed values: role keywords, first list that hits wins ------------------------------
ROLE_KEYWORDS = {
    "Data Analyst": ["sql", "join", "having", "aggregate", "dashboard", "report", "clean"],
    "AI Engineer": ["llm", "transformer", "rag", "tokenizer", "agent", "prompt", "embedding"],
    "Machine Learning Engineer": ["gradient", "overfit", "loss", "optimizer", "model", "neural", "hyperparameter"],
}
FALLBACK_ROLE = "Data Scientist"
PROJECT_WORDS = ["project", "built", "developed", "implemented", "deployed", "worked on"]

# --- fixed values: bank row texts ---------------------------------------------------------
DOCUMENT_TEXT = "Role: {role}. Type: {type}. Question: {question}"
QUERY_TEXT = "Interview questions for a {role}. Candidate background: {resume} Focus: {question_type}"
EXTRACTED_STRATEGY = "Flow Driven"
STAR_STRATEGY = "STAR Method"
STAR_STRATEGY_ROLE = "Data Scientist"
CURATED_STRATEGY = "Direct Answer"
EXTRACTED_CATEGORY = "Core Concept"
CURATED_CATEGORY = "Technical Topic"
EXTRACTED_TAG = "Concepts"
CURATED_TAG = "Technical"
EXTRACTED_ANSWER = (
    "To address the question '{question}': we must evaluate the core theoretical mechanics. "
    "For this context, standard practice involves structuring features, adjusting hyperparameter thresholds, "
    "evaluating using robust metrics, and optimizing resource bottlenecks during inference."
)

# --- fixed values: padding rows, {n} is the row's place in the role's list ------------------
PADDING = {
    "Data Scientist": (
        "Explain data science methodology option {n} for experiment design.",
        "This question checks experimental configuration option {n}. In practice, we define hypotheses, calculate "
        "statistical power to identify sample minimums, monitor for metric leakage, control for selection bias, "
        "and deploy statistical models.",
    ),
    "Data Analyst": (
        "Explain SQL optimization pattern {n} for reporting.",
        "This question checks query execution strategy {n}. In practice, we avoid SELECT *, create appropriate "
        "indexes, use temporary tables/CTEs for subqueries, filter rows early with WHERE, and optimize window "
        "function partition clauses.",
    ),
    "AI Engineer": (
        "Explain generative AI model architectural feature {n} for production optimization.",
        "This question addresses deployment optimization {n}. Solutions use key-value caching (KV Cache), pipeline "
        "parallelism, flash attention kernels, tensor serialization via Safetensors, and micro-batch inference "
        "configurations.",
    ),
}

# --- fixed values: behavioural themes ---------------------------------------------------------
THEMES = [
    ("Conflict Resolution",
     "Tell me about a time you disagreed with a colleague or manager on a technical approach. "
     "How did you handle it?"),
    ("Adaptability",
     "Describe a situation where project requirements changed drastically at the last minute. What did you do?"),
    ("Leadership",
     "Can you share an example of a time you had to take the lead on a difficult project without formal authority?"),
    ("Communication",
     "Explain how you would communicate a complex technical concept or model result to a non-technical "
     "stakeholder."),
    ("Failure",
     "Tell me about a time a project you worked on failed or a model underperformed in production. "
     "What did you learn?"),
    ("Time Management",
     "How do you prioritize your work when you have multiple tight deadlines? Provide a specific example."),
    ("Continuous Learning",
     "The AI/Data field moves incredibly fast. How do you stay updated, and can you give an example of applying "
     "a newly learned concept?"),
    ("Ethics",
     "If you discovered bias in a dataset you were using for a critical model, how would you address it with "
     "your team?"),
    ("Teamwork",
     "Describe your role in a successful cross-functional team project. What was the most challenging part of "
     "collaborating?"),
    ("Problem Solving",
     "Tell me about the most complex technical problem you've faced and the steps you took to solve it."),
]
BEHAVIORAL_QUESTION = "[{theme} - {experience} {role}] {base_question}"
BEHAVIORAL_ANSWER = (
    "Use the STAR method (Situation, Task, Action, Result). "
    "Focus on showing soft skills relevant to a {experience}-level {role}. "
    "Emphasize collaboration, empathy, clear communication, and taking ownership of outcomes."
)
BEHAVIORAL_STRATEGY = "STAR method"

# --- fixed values: messages -------------------------------------------------------------------
NO_ANSWER = "No model answer available."
SHORT_BACKGROUND = (
    "- Please provide a valid, detailed resume or background summary to generate a personalized strategy."
)
STRATEGY_NO_KEY = "API key is missing. Cannot generate strategy."
STRATEGY_BAD_PARSE = "- Failed to parse generated strategy."
STRATEGY_NO_RESPONSE = "- Failed to generate strategy."
REPORT_NO_HISTORY = "No interview history found for this session."
REPORT_NO_RESPONSE = "Failed to generate report."
PAGE_NO_HISTORY = "No interview history found. Go back home and take your first mock interview!"
NO_QUESTIONS = "No questions found for this role in the database."
UNSUPPORTED_FILE = "Only PDF or DOCX files are supported."
TIER_EASIER = "The candidate has struggled recently. Please ask an EASIER, more fundamental question."
TIER_HARDER = "The candidate is doing great. Please ask a HARDER, more advanced question."
WEAK_AREAS_HEADING = "Top Weak Areas:"
STUDY_PLAN_HEADING = "Quick Study Plan:"
HISTORY_LINE = "Q: {question} | Score: {score}/10"
MOCK_EVALUATION = (
    '{"score":7,"summary":"Mock summary.","strengths":["Mock strength"],"weaknesses":["Mock weakness"],'
    '"improvement_tips":["Mock tip"],"improved_answer":"Mock improved answer."}'
)

# --- fixed values: prompt wording ----------------------------------------------------------------
STRATEGY_PROMPT = (
    "You are an expert career coach.\n"
    "Candidate Name: {profile_name}\n"
    "Candidate Role: {experience} {role}\n"
    "Candidate Background: {resume}\n\n"
    "Based ONLY on their background, generate a personalized Preparation Strategy. Output strictly in VALID JSON "
    "format with the exact key 'strategy_bullets' (list of strings, max 4).\n"
    "Do not output any conversational text, markdown formatting, or filler. Only JSON."
)
QUESTION_PROMPT = (
    "You are an expert technical interviewer.\n"
    "Candidate Name: {profile_name}\n"
    "Candidate Role: {experience} {role}\n"
    "Question Type Focus: {question_type}\n"
    "Candidate Background: {resume}\n\n"
    "Reference Topics:\n{reference_questions}\n\n"
    "Based ONLY on the candidate's exact background and the Question Type Focus, generate a highly customized "
    "interview question for them. {tier} "
    "CRITICAL RULE: The candidate's experience level is {experience}. Do NOT ask questions that are too advanced "
    "for their level. "
    "If they are 'Junior' or have 0 experience, focus heavily on fundamentals, basic definitions, and simple "
    "scenarios. "
    "If they are 'Senior', focus on deep architecture, system design, and trade-offs. "
    "Also provide a concise model answer for the generated question.\n\n"
    "Output strictly in VALID JSON format with exact keys 'question' and 'model_answer'. Do not output any "
    "markdown formatting or extra text.\n"
    "{{\n"
    '  "question": "[your question here]",\n'
    '  "model_answer": "[your answer here]"\n'
    "}}"
)
FRAME_PROMPT = (
    "You are a career coach helping a {experience} {role} answer an interview question.\n"
    "Question: {question}\n\n"
    "The candidate's key points:\n{points}\n\n"
    "Using ONLY these key points, write a concise, well-structured answer (3-5 sentences) "
    "using the STAR method where applicable. Do not invent facts not in the key points.\n\n"
    "CRITICAL RULE: DO NOT output any conversational filler. Do not say 'Here is your answer' or 'Let me know if "
    "you need help' or 'I am open to suggestions'. Output ONLY the framed answer text and nothing else.\n\n"
    "Answer:"
)
EVALUATION_PROMPT = (
    "You are an expert technical interviewer evaluating a candidate's response.\n"
    "Question: {question}\n"
    "Model Answer: {model_answer}\n"
    "Candidate's Answer: {user_answer}\n\n"
    "CRITICAL RULES:\n"
    "1. ONLY evaluate the Candidate's Answer. Do NOT evaluate the Model Answer.\n"
    "2. If the Candidate's Answer is evasive (e.g., 'you tell me', 'I don't know'), extremely short, nonsensical, "
    "or completely incorrect, you MUST give a score of 0, 1, or 2.\n"
    "3. Be a strict grader. Only give 8+ if the answer is highly detailed and technically accurate.\n\n"
    "Evaluate the candidate and output strictly in VALID JSON format with exact keys: "
    "'score' (integer 0-10), 'summary' (string), 'strengths' (list of strings), 'weaknesses' (list of strings), "
    "'improvement_tips' (list of strings), 'improved_answer' (string).\n"
    "Do not output any markdown formatting or extra text."
)
REPORT_PROMPT = (
    "You are a strict career coach giving a final debrief.\n"
    "Candidate: {profile_name} ({role})\n"
    "Average Score: {average}/10\n"
    "Session History:\n{history}\n\n"
    "Generate a VERY BRIEF summary report. Output strictly in VALID JSON format with exact keys: "
    "'weak_areas' (list of strings, max 2), 'study_plan' (list of strings, max 2).\n"
    "Do not output any conversational text, markdown formatting, or filler. Only JSON."
)
