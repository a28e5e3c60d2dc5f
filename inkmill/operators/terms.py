"""The built-in glossary: AI and machine learning terms."""

from __future__ import annotations

# Terms and their translations, in order; a term that maps to itself stays English.
BUILTIN: tuple[tuple[str, str], ...] = (
    ("attention", "注意力机制"),
    ("self-attention", "自注意力"),
    ("cross-attention", "交叉注意力"),
    ("multi-head attention", "多头注意力"),
    ("scaled dot-product attention", "缩放点积注意力"),
    ("transformer", "Transformer"),
    ("encoder", "编码器"),
    ("decoder", "解码器"),
    ("encoder-decoder", "编码器—解码器"),
    ("embedding", "嵌入"),
    ("token", "token"),
    ("tokenizer", "分词器"),
    ("tokenization", "分词"),
    ("positional encoding", "位置编码"),
    ("rotary position embedding", "旋转位置编码"),
    ("RoPE", "RoPE"),
    ("layer normalization", "层归一化"),
    ("batch normalization", "批归一化"),
    ("residual connection", "残差连接"),
    ("feed-forward network", "前馈网络"),
    ("FFN", "FFN"),
    ("MLP", "MLP"),
    ("gated linear unit", "门控线性单元"),
    ("GLU", "GLU"),
    ("large language model", "大语言模型"),
    ("LLM", "LLM"),
    ("foundation model", "基础模型"),
    ("pre-training", "预训练"),
    ("fine-tuning", "微调"),
    ("instruction tuning", "指令微调"),
    ("supervised fine-tuning", "监督微调"),
    ("SFT", "SFT"),
    ("reinforcement learning from human feedback", "基于人类反馈的强化学习"),
    ("RLHF", "RLHF"),
    ("direct preference optimization", "直接偏好优化"),
    ("DPO", "DPO"),
    ("proximal policy optimization", "近端策略优化"),
    ("PPO", "PPO"),
    ("reward model", "奖励模型"),
    ("reward hacking", "奖励黑客"),
    ("alignment", "对齐"),
    ("preference alignment", "偏好对齐"),
    ("in-context learning", "上下文学习"),
    ("ICL", "ICL"),
    ("few-shot", "少样本"),
    ("zero-shot", "零样本"),
    ("one-shot", "单样本"),
    ("chain-of-thought", "思维链"),
    ("CoT", "CoT"),
    ("tree-of-thought", "思维树"),
    ("self-consistency", "自一致性"),
    ("prompt engineering", "提示工程"),
    ("prompt tuning", "提示微调"),
    ("prefix tuning", "前缀微调"),
    ("prompting", "提示"),
    ("mixture of experts", "专家混合"),
    ("MoE", "MoE"),
    ("sparse model", "稀疏模型"),
    ("dense model", "稠密模型"),
    ("expert", "专家"),
    ("routing", "路由"),
    ("router", "路由器"),
    ("load balancing", "负载均衡"),
    ("key-value cache", "KV 缓存"),
    ("KV cache", "KV 缓存"),
    ("prefill", "prefill"),
    ("decoding", "解码"),
    ("autoregressive", "自回归"),
    ("speculative decoding", "投机解码"),
    ("beam search", "束搜索"),
    ("greedy decoding", "贪心解码"),
    ("top-k sampling", "top-k 采样"),
    ("top-p sampling", "top-p 采样"),
    ("nucleus sampling", "核采样"),
    ("temperature", "温度"),
    ("quantization", "量化"),
    ("pruning", "剪枝"),
    ("distillation", "蒸馏"),
    ("knowledge distillation", "知识蒸馏"),
    ("LoRA", "LoRA"),
    ("low-rank adaptation", "低秩自适应"),
    ("PEFT", "PEFT"),
    ("parameter-efficient fine-tuning", "参数高效微调"),
    ("adapter", "适配器"),
    ("retrieval-augmented generation", "检索增强生成"),
    ("RAG", "RAG"),
    ("retriever", "检索器"),
    ("vector database", "向量数据库"),
    ("vector store", "向量库"),
    ("dense retrieval", "稠密检索"),
    ("sparse retrieval", "稀疏检索"),
    ("reranker", "重排器"),
    ("BM25", "BM25"),
    ("agent", "智能体"),
    ("multi-agent", "多智能体"),
    ("tool use", "工具使用"),
    ("function calling", "函数调用"),
    ("planning", "规划"),
    ("reasoning", "推理"),
    ("benchmark", "基准"),
    ("evaluation", "评测"),
    ("perplexity", "困惑度"),
    ("accuracy", "准确率"),
    ("precision", "精确率"),
    ("recall", "召回率"),
    ("F1 score", "F1 分数"),
    ("BLEU", "BLEU"),
    ("ROUGE", "ROUGE"),
    ("MMLU", "MMLU"),
    ("HumanEval", "HumanEval"),
    ("gradient descent", "梯度下降"),
    ("stochastic gradient descent", "随机梯度下降"),
    ("SGD", "SGD"),
    ("Adam", "Adam"),
    ("AdamW", "AdamW"),
    ("learning rate", "学习率"),
    ("warmup", "预热"),
    ("schedule", "调度"),
    ("weight decay", "权重衰减"),
    ("loss function", "损失函数"),
    ("cross-entropy loss", "交叉熵损失"),
    ("backpropagation", "反向传播"),
    ("forward pass", "前向传播"),
    ("backward pass", "反向传播"),
    ("overfitting", "过拟合"),
    ("underfitting", "欠拟合"),
    ("regularization", "正则化"),
    ("dropout", "dropout"),
    ("epoch", "轮次"),
    ("batch size", "批大小"),
    ("mini-batch", "小批量"),
    ("convolutional neural network", "卷积神经网络"),
    ("CNN", "CNN"),
    ("recurrent neural network", "循环神经网络"),
    ("RNN", "RNN"),
    ("LSTM", "LSTM"),
    ("GRU", "GRU"),
    ("graph neural network", "图神经网络"),
    ("GNN", "GNN"),
    ("diffusion model", "扩散模型"),
    ("latent diffusion", "潜在扩散"),
    ("variational autoencoder", "变分自编码器"),
    ("VAE", "VAE"),
    ("generative adversarial network", "生成对抗网络"),
    ("GAN", "GAN"),
    ("computer vision", "计算机视觉"),
    ("natural language processing", "自然语言处理"),
    ("NLP", "NLP"),
    ("speech recognition", "语音识别"),
    ("text-to-speech", "文本转语音"),
    ("TTS", "TTS"),
    ("dataset", "数据集"),
    ("training set", "训练集"),
    ("validation set", "验证集"),
    ("test set", "测试集"),
    ("data augmentation", "数据增强"),
    ("sampling", "采样"),
    ("inference", "推理"),
    ("latency", "延迟"),
    ("throughput", "吞吐量"),
    ("zero-shot transfer", "零样本迁移"),
    ("transfer learning", "迁移学习"),
    ("domain adaptation", "领域自适应"),
    ("out-of-distribution", "分布外"),
    ("OOD", "OOD"),
    ("robustness", "鲁棒性"),
    ("generalization", "泛化"),
    ("safety", "安全"),
    ("jailbreak", "越狱"),
    ("prompt injection", "提示注入"),
    ("hallucination", "幻觉"),
    ("toxicity", "毒性"),
    ("bias", "偏见"),
    ("fairness", "公平性"),
    ("scaling law", "扩展规律"),
    ("scaling", "扩展"),
    ("emergent ability", "涌现能力"),
    ("emergence", "涌现"),
    ("compute", "算力"),
    ("FLOPs", "FLOPs"),
    ("GPU hour", "GPU 小时"),
    ("state-of-the-art", "最先进"),
    ("SOTA", "SOTA"),
    ("baseline", "基线"),
    ("ablation study", "消融实验"),
    ("hyperparameter", "超参数"),
    ("checkpoint", "检查点"),
)
