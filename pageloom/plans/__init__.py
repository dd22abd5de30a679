"""Jobs composed of the operators: dataset, index, answers, evaluation, report."""
