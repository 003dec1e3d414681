"""shoplens.plans"""
