"""Fixed values of the oracle: labels, texts and thresholds that its SQL must produce.

Spelled out here on purpose, apart from the operators, so that a wrong label or
sentence in one of them shows as a difference.
"""

# Test-table adapter.
LENDERS_PER_SUPPLIERS = 5
STATE_BY_REGION = ['CA', 'FL', 'MI', 'NY', 'WA']
AGE_BUCKETS = ['<25', '25-34', '35-44', '45-54', '55-64', '65-74', '>74', 'NA']
DTI_BUCKETS = ['<20%', '20%-<30%', '30%-<36%', '36', '40', '45', '50%-60%', '>60%', 'NA', 'Exempt']
DWELLING_CATEGORIES = ['Single Family (1-4 Units):Site-Built',
 'Single Family (1-4 Units):Manufactured',
 'Multifamily:Site-Built',
 'Multifamily:Manufactured']
LOAN_PRODUCTS = ['Conventional:First Lien',
 'FHA:First Lien',
 'VA:First Lien',
 'FSA/RHS:First Lien',
 'Conventional:Subordinate Lien',
 'FHA:Subordinate Lien']

# Rules and explanations.
MINORITY_RACES = ['Black', 'Asian', 'American_Indian', 'Hawaiian_Pacific']
EXPLANATIONS = [('R001_ai_violation', 'AI-verified: Qualified applicant with similar approved profiles inappropriately denied'),
 ('R003_ai_violation', 'AI-verified: Vector similarity shows racial discrimination in similar financial profiles'),
 ('R004_ai_violation', 'AI-verified: Vector similarity shows gender discrimination in similar financial profiles'),
 ('R005_ai_violation', 'AI-verified: Vector similarity shows ethnic discrimination in similar financial profiles'),
 ('R006_ai_violation', 'AI cluster analysis: Anomalous denial in minority area detected'),
 ('R007_ai_violation', 'AI pattern recognition: Outlier in minority lending cluster identified'),
 ('R008_ai_violation', 'AI multi-dimensional analysis: Intersectional discrimination detected')]
OUTLIER_EXPLANATION = 'AI clustering: Application is statistical outlier in embedding space'
DISPARITY_EXPLANATION = ('AI cluster disparity: ', ' detected')
RULES = [('R001', 'Core_Business', 8.0, 'High income applicants with similar approved profiles should be approved'),
 ('R002', 'Core_Business', 7.5, 'High risk applicants with similar denied profiles should face scrutiny'),
 ('R003',
  'Fair_Lending_AI',
  9.0,
  'Financially similar applicants should have similar outcomes regardless of race - AI verified'),
 ('R004',
  'Fair_Lending_AI',
  8.5,
  'Financially similar applicants should have similar outcomes regardless of gender - AI verified'),
 ('R005',
  'Fair_Lending_AI',
  8.0,
  'Financially similar applicants should have similar outcomes regardless of ethnicity - AI verified'),
 ('R006', 'AI_Pattern_Detection', 7.0, 'AI detected anomalous denials in minority areas'),
 ('R007', 'AI_Pattern_Detection', 6.5, 'AI identified outliers in minority lending patterns'),
 ('R008', 'AI_Intersectional', 6.0, 'AI detected intersectional discrimination patterns'),
 ('R009', 'AI_Validation', 5.0, 'High confidence AI discrimination detection with statistical support')]

# Report, dashboard and summary texts.
VERIFIED_TYPES = [('ai_black_disparity_flag', 'AI-Verified Racial Discrimination (Black)'),
 ('ai_hispanic_disparity_flag', 'AI-Verified Ethnic Discrimination (Hispanic)'),
 ('ai_gender_disparity_flag', 'AI-Verified Gender Discrimination'),
 ('ai_redlining_flag', 'AI-Verified Redlining Pattern')]
DASHBOARD_TITLE = '=== AI-ENHANCED MARKOV LOGIC NETWORK FAIR LENDING ANALYSIS ==='
DASHBOARD_STATIC_ROWS = [('AI-MLN IMPLEMENTATION VERIFICATION',
  'Vector Similarity Rules Implemented',
  'TRUE',
  'First-order logic rules enhanced with vector similarity validation'),
 ('AI-MLN IMPLEMENTATION VERIFICATION',
  'Embedding Cluster Analysis',
  'TRUE',
  'AI-powered cluster anomaly detection for discrimination patterns'),
 ('AI-MLN IMPLEMENTATION VERIFICATION',
  'Multi-dimensional Intersectional Analysis',
  'TRUE',
  'AI embedding space analysis for complex discrimination detection'),
 ('=== AI-MLN TECHNOLOGY ADVANTAGES ===',
  None,
  None,
  'Advanced capabilities beyond traditional discrimination detection'),
 ('AI TECHNOLOGY BENEFITS',
  'Vector Similarity Evidence',
  'IMPLEMENTED',
  'Concrete mathematical proof of similar treatment disparities'),
 ('AI TECHNOLOGY BENEFITS',
  'Embedding Cluster Patterns',
  'IMPLEMENTED',
  'Systematic discrimination pattern identification through clustering'),
 ('AI TECHNOLOGY BENEFITS',
  'Multi-dimensional Analysis',
  'IMPLEMENTED',
  'Intersectional discrimination detection in high-dimensional space'),
 ('AI TECHNOLOGY BENEFITS',
  'Automated Anomaly Detection',
  'IMPLEMENTED',
  'AI-powered outlier identification for regulatory efficiency'),
 ('AI TECHNOLOGY BENEFITS',
  'Confidence-Weighted Evidence',
  'IMPLEMENTED',
  'AI confidence scoring enhances traditional statistical evidence'),
 ('=== SYSTEM DEPLOYMENT STATUS ===', None, None, 'Production readiness and regulatory compliance verification'),
 ('DEPLOYMENT READINESS',
  'AI-Enhanced MLN Implementation',
  'COMPLETE',
  'True MLN with BigQuery AI vector similarity and clustering'),
 ('DEPLOYMENT READINESS',
  'Vector Index Performance',
  'OPTIMIZED',
  'Cosine similarity search with IVF indexing for sub-second response'),
 ('DEPLOYMENT READINESS',
  'Embedding Generation Scalability',
  'VERIFIED',
  'Handles millions of applications with text-embedding-gecko model'),
 ('DEPLOYMENT READINESS',
  'Regulatory Compliance',
  'AI-ENHANCED',
  'Explainable AI with vector similarity evidence for legal proceedings')]
DASHBOARD_METRICS = {'embedded_apps': ('AI-ENHANCED DATA PROCESSING',
                   'Total Applications with AI Embeddings',
                   'Applications processed with vector embeddings and clustering'),
 'pairs': ('AI-ENHANCED DATA PROCESSING',
           'Vector Similarity Pairs Identified',
           'High-similarity financial profile pairs for discrimination detection'),
 'clusters': ('AI-ENHANCED DATA PROCESSING',
              'AI Embedding Clusters Created',
              'K-means clusters for pattern recognition and anomaly detection'),
 'critical': ('AI-ENHANCED DISCRIMINATION DETECTION',
              'AI-Critical Violations Detected',
              'Applications with severe AI-verified MLN constraint violations'),
 'tier1': ('AI-ENHANCED DISCRIMINATION DETECTION',
           'AI Tier 1 Critical Lenders',
           'Lenders requiring immediate regulatory attention with AI validation'),
 'very_high': ('AI-ENHANCED DISCRIMINATION DETECTION',
               'Vector-Verified Discrimination Cases',
               'High-confidence discrimination cases with vector similarity evidence'),
 'di_strong': ('AI-ENHANCED STATISTICAL VALIDATION',
               'AI-Verified Disparate Impact Cases',
               'Statistically significant disparities with strong AI validation'),
 'accuracy': ('AI-MLN MODEL PERFORMANCE',
              'AI-Enhanced Model Accuracy',
              'Accuracy on validation set with AI-verified discrimination patterns'),
 'f1': ('AI-MLN MODEL PERFORMANCE',
        'AI-Enhanced F1-Score',
        'Balanced precision and recall with vector similarity validation'),
 'auc': ('AI-MLN MODEL PERFORMANCE',
         'AI-Enhanced AUC Score',
         'Area under curve with embedding-based discrimination detection'),
 'exams': ('AI-ENHANCED REGULATORY IMPACT',
           'AI-Immediate Examinations Recommended',
           'Lenders requiring immediate examination with vector similarity evidence'),
 'enforcement': ('AI-ENHANCED REGULATORY IMPACT',
                 'Very High AI Enforcement Risk Cases',
                 'Cases with very high enforcement success probability using AI evidence')}
SUMMARY_STATUS = 'AI-ENHANCED MLN IMPLEMENTATION COMPLETE'
SUMMARY_CONFIRMATION = 'True Markov Logic Network enhanced with BigQuery AI vector embeddings, similarity search, and clustering'
SUMMARY_FORMAT = 'Processed %d applications using AI-enhanced MLN with %d vector similarity pairs and %d embedding clusters'
